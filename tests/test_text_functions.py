"""Golden cases of the column functions."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketlake.functions import dates, doctype, files, naming, regions, replies, vendors
from docketlake.functions.text import file_extension, iso_timestamp, leading_literal


def check(one, expression, cases):
    """Each case is (input, ..., expected); inputs become columns a, b, c."""
    width = len(cases[0]) - 1
    names = "abc"[:width]
    rows = [tuple(c[:-1]) + (i,) for i, c in enumerate(cases)]
    schema = ", ".join(f"{n} string" for n in names) + ", i int"
    out = one(rows, schema, i=F.col("i"), x=expression(*[F.col(n) for n in names]))
    got = {r["i"]: r["x"] for r in out}
    for i, case in enumerate(cases):
        assert got[i] == case[-1], (case, got[i])


def test_normalize_vendor(one):
    check(one, vendors.normalize_vendor, [
        ("Acme Corp", "acme"), ("Acme Corporation Inc.", "acme"), ("Beta LLC", "beta"),
        ("Gamma Ltd.", "gamma"), ("Delta & Sons, Co.", "delta sons"), ("", ""), (None, ""),
        ("The Widget Company PLC", "the widget"), ("Omega L.L.P.", "omega"), ("Müller Inc", "müller"),
        ("Incorporated Corporate", "corporate"),
    ])


def test_suffixes_go_in_their_order(one):
    import random
    import re

    from docketlake import fixed

    rnd = random.Random(3)
    parts = ["llc", "l.l.c.", "inc", "inc.", "corp.", "co", "co.", "ltd.", ".", " ", ",", "x", "l.", "p.", "l.l.p.", "-"]
    names = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    cases = []
    for name in names:
        out = name.lower()
        for suffix in fixed.VENDOR_SUFFIX_PATTERNS:
            out = re.sub(suffix, "", out)
        out = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", out)).strip()
        cases.append((name, out))
    check(one, vendors.normalize_vendor, cases)


def test_clean_vendor(one):
    check(one, vendors.clean_vendor, [
        ("Acme Corp", "AcmeCorp"), ("Beta LLC", "BetaLLC"), ("Gamma-Soft", "GammaSoft"),
        ("Delta & Co.", "DeltaCo"), ("", "UnknownVendor"), (None, "UnknownVendor"),
        ("Widget Co.", "WidgetCo"), ("&&&", "UnknownVendor"), ("über gmbh", "Übergmbh"),
    ])


def test_vendor_from_folder(one):
    check(one, vendors.vendor_from_folder, [
        ("Acme Corp", "acme corp"), ("Acme Corp Contracts", "acme corp"), ("contracts", None),
        ("documents", None), ("temp", None), ("", None), (None, None),
        ("123e4567-e89b-12d3-a456-426614174000", None), ("Contracts_Archive", "Contracts_Archive"),
        ("Acme_Agreements-Files", "acme"), ("  ", "  "),
    ])


def test_vendor_from_filename(one):
    check(one, vendors.vendor_from_filename, [
        ("Acme_Corp_MSA_2024.pdf", "Acme Corp"), ("Globex-NDA-final.docx", "Globex"),
        ("2024_Acme.pdf", None), ("Initech.pdf", "Initech"), ("", None), (None, None),
        ("A1 B2 12345 draft.doc", "A1 B2 12345"),
    ])


def test_vendor_cascade(one):
    check(one, vendors.vendor_cascade, [
        (" Told ", "Globex Inc", "File_MSA.pdf", "Told"), ("", "Globex Inc", "File_MSA.pdf", "globex inc"),
        (None, "contracts", "File_MSA.pdf", "File"), ("", "", "MSA.pdf", ""),
    ])
    check(one, lambda a, b, c: vendors.vendor_cascade(a, b, c, "Unknown"), [("", "", "MSA.pdf", "Unknown")])


def test_document_type(one):
    check(one, doctype.document_type, [
        ("This Master Service Agreement governs the relationship.", "", "MSA"),
        ("", "contract msa 2024.pdf", "MSA"), ("", "Synthetic_Acme_scanned_signed_MSA.pdf", "MSA"),
        ("Statement of Work for consulting services.", "", "SOW"),
        ("Non-Disclosure Agreement between parties.", None, "NDA"),
        ("Purchase Order #12345 for hardware.", "", "PO"), ("our p.o. is attached", "", "PO"),
        ("This amendment modifies the original agreement.", "", "AMD"),
        ("Software License Agreement for enterprise use.", "", "LICENSE"),
        ("some random text without keywords", "", "CONTRACT"), ("hello world", "msa final.pdf", "MSA"),
        (None, None, "CONTRACT"),
        # a tie goes to the type listed first, the name counts three times
        ("nda and sow", "", "SOW"), ("sow sow amendment", "amendment.pdf", "AMD"),
    ])


def test_retention_category(one):
    cases = [("MSA", "y", "long_term"), ("MSA", None, "indefinite"), ("SOW", None, "contracts"),
             ("NDA", None, "indefinite"), ("LICENSE", "y", "indefinite"), ("PO", None, "short_term"),
             ("AMD", "y", "tied_to_parent"), ("UNKNOWN", None, "review_required"), (None, None, "review_required"),
             ("agreement", "y", "long_term")]
    check(one, lambda a, b: doctype.retention_category(a, b.isNotNull()), cases)


def test_keyword_score(one):
    check(one, lambda a, b: doctype.keyword_score(a, b, "draft"), [
        ("draft_v1.pdf", "working draft, unsigned", 8), ("x", None, 0), ("x", "", 0),
    ])


def test_clean_filename(one):
    check(one, naming.clean_filename, [
        ("file:name.txt", "file_name.txt"), ("file\\name.txt", "file_name.txt"), ("file//name.txt", "file_name.txt"),
        ("<bad>.txt", "bad_.txt"), ("__leading__.txt", "leading_.txt"), ("trailing__ ", "trailing"),
    ])


def test_format_file_size(one):
    sizes = [(0, "0B"), (512, "512.0B"), (1024, "1.0KB"), (1536, "1.5KB"), (1024 ** 2, "1.0MB"),
             (1024 ** 3, "1.0GB"), (1024 ** 5, "1024.0TB"), (1280, "1.2KB"), (1023, "1023.0B")]
    out = one([(s,) for s, _ in sizes], "s long", s=F.col("s"), x=naming.format_file_size(F.col("s")))
    assert {r["s"]: r["x"] for r in out} == dict(sizes)


def test_file_names(one):
    check(one, lambda a: file_extension(a), [
        ("a.pdf", ".pdf"), (".bashrc", ""), ("a.tar.gz", ".gz"), ("dir.x/file", ""), ("a.", "."), ("..a", ""), ("x", ""),
    ])
    check(one, lambda a, b: naming.enhanced_filename(a, b, F.lit("old.pdf"), F.lit(1)), [
        ("AcmeCorp", "MSA", "AGMT_AcmeCorp_masterServiceAgreement_001.pdf"), ("A", "MEMO", "K_A_document_001.pdf"),
    ])
    wide = one([(1234,)], "n long", x=naming.enhanced_filename(F.lit("A"), F.lit("PO"), F.lit("x.txt"), F.col("n")))
    assert wide[0]["x"] == "K_A_purchaseOrder_1234.txt"
    check(one, lambda a, b: naming.simple_filename(a, F.lit("old.pdf"), b), [
        ("Acme", "20240115", "20240115_Acme_old.pdf"), ("Acme", None, "Acme_old.pdf"), ("Acme", "", "Acme_old.pdf"),
    ])


def test_latest_date(one):
    check(one, dates.latest_date, [
        ("Effective March 15, 2024", None, "20240315"), ("Sept 5, 2020", None, "20200905"), ("on 5 March 2021", None, "20210305"),
        ("March 5th, 2021", None, "20210305"), ("12/31/99", None, "19991231"), ("1-2-34", None, "20340102"),
        ("this 5th day of March, 2021", None, "20210305"), ("1st of Sept., 2020", None, "20200901"),
        ("the 22ND DAY OF SEPTEMBER 2019", None, "20190922"), ("Oct. 3 2018", None, "20181003"), ("12/31/199", None, None),
        ("signed March 2021", None, "20210301"), ("in Dec of 2020", None, "20201201"), ("2021.03.05", None, "20210305"),
        ("5.3.2021", None, "20210503"), ("Mar-05-2021", None, "20210305"), ("05-Mar-2021", None, "20210305"),
        ("2021-Mar-05", None, "20210305"), ("25/3/2021", None, "20210325"), ("25.3.2021", None, "20210325"),
        ("March 5,2021", None, "20210305"), ("section 5.3.21", None, None), ("March 05, then", None, None), ("13.13.2021", None, None),
        ("May 32, 2021", None, None), ("June 20215", None, None),
        ("30 Feb 2020", None, None), ("2/30/20", None, None), ("2/29/96", None, "19960229"), ("112/31/99", None, None), ("no dates here", "", None), (None, None, None),
        ("1/2/2020 and 2019-05-06", "Acme_2021-03-04.pdf", "20210304"), ("in 2036: 2036-01-01", "", None),
        ("Feb 3 1999, 12-31-1998", "", "19990203"), ("2024-02-30", "", None),
    ])


def test_lifecycle_dates(one):
    text = (
        "Effective date: June 1, 2024. This agreement expires on December 31, 2025. "
        "Automatically renews on January 1, 2025; Subject to review on 7/15/2024. "
        "The termination date is 2026-03-04."
    )
    got = one([(text,), ("no relevant dates",), (None,)], "t string", d=dates.lifecycle_dates(F.col("t")))
    first = got[0]["d"].asDict()
    assert first == {
        "effective_date": None if first["effective_date"] is None else date(2024, 6, 1),
        "expiration_date": date(2025, 12, 31), "signature_date": None, "renewal_date": date(2025, 1, 1),
        "termination_date": date(2026, 3, 4), "review_date": date(2024, 7, 15),
    }
    assert first["effective_date"] == date(2024, 6, 1)
    for other in got[1:]:
        assert set(other["d"].asDict().values()) == {None}


def test_lifecycle_uses_three_matches_and_year_bounds(one):
    text = "expires soon; expires never; expires later; expires 1/1/2020"
    late = "expires 1/1/2041; expires 2/2/2030"
    got = one([(text,), (late,)], "t string", d=dates.lifecycle_dates(F.col("t"))["expiration_date"])
    assert [r["d"] for r in got] == [None, date(2030, 2, 2)]


def test_regions(one):
    check(one, regions.has_region, [
        ("between Alpha Corp and Beta Widgets (the vendor)", True),
        ("and Acme Widgets, hereinafter referred to as Vendor", True),
        ("Acme Widgets, a Delaware corporation", True), ("NON DISCLOSURE AGREEMENT", True), ("nondisclosure agreement", True),
        ("plain words only", False), ("", False), (None, False), ("between two and three (", True),
    ])


def test_region_guards_change_nothing(one):
    import random
    import re

    from docketlake import fixed

    rnd = random.Random(1)
    parts = ["and ", "between ", "Acme", " hereinafter ", "called", "referred", ", ", "a Delaware ", "corporation",
             "llc", "(", ". ", "x", "\n", "amendment", "é", "9"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 14))) for _ in range(600)]
    want = [any(re.search(p, t, re.I) for p in fixed.REGION_PATTERNS) for t in texts]
    assert any(want) and not all(want)
    check(one, regions.has_region, list(zip(texts, want)))


def test_replies(one):
    raw = [
        ('{"doc_type": "msa", "vendor": " Acme "}', ("MSA", "Acme")),
        ('Sure! {"doc_type": "NDA", "vendor": "B"} ok', ("NDA", "B")),
        ("doc_type: SOW, vendor: Globex.", ("SOW", "Globex")), ("Doc Type = MEMO; Vendor: 'X'", ("", "X")),
        ("", ("", "")), (None, ("", "")), ('{"vendor": "Only"}', ("", "Only")), ("[1, 2]", ("", "")),
        ('{"doc_type": "MEMO", "vendor": "B"}', ("", "")), ("{'doc_type': 'MSA'}", ("", "")),
        ('{"doc_type": "PO", "vendor": null}', ("PO", "None")),
    ]
    got = one([(r, i) for i, (r, _) in enumerate(raw)], "r string, i int", i=F.col("i"), x=replies.parsed_reply(F.col("r")))
    for row in got:
        assert tuple(row["x"]) == raw[row["i"]][1], raw[row["i"]]


def test_training_target_is_json(one):
    vendor = 'A "quoted" \\ name'
    got = one([(vendor,)], "v string", x=replies.training_target(F.lit("MSA"), F.col("v")))
    assert json.loads(got[0]["x"]) == {"doc_type": "MSA", "vendor": vendor}


def test_iso_timestamp(one):
    got = one([("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.25",)], "t string",
              x=iso_timestamp(F.col("t").cast("timestamp")))
    assert [r["x"] for r in got] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.250000"]


@pytest.mark.parametrize("pattern,literal", [
    (r"(?<!\w)p\.o\.(?!\w)", "p.o."), (r"e-?signature", "e"), (r"electronic(?:ally)?\s+x", "electronic"),
    (r"/s/\s*", "/s/"), (r"starts?\s", "start"), (r"\d+x", ""), (r"by:\s*[_\-\s]*", "by:"),
])
def test_leading_literal(pattern, literal):
    assert leading_literal(pattern) == literal


def test_content_checks(spark):
    rows = [
        ("/a/x.pdf", b"%PDF-1.4", None), ("/a/y.pdf", b"plain", "Uploaded file content does not match .pdf extension"),
        ("/a/e.txt", b"", "Uploaded file is empty"), ("/a/n.txt", b"ab\x00c", "Uploaded file content does not match .txt extension"),
        ("/a/late.txt", b"abcdefghij\x00", None), ("/a/d.docx", b"PK\x03\x04zzPK\x05\x06", None),
        ("/a/w.docx", b"nozip", "Uploaded file content does not match .docx extension"), ("/a/o.doc", b"any", None),
        ("/a/q.exe", b"MZ", "Unsupported file type: .exe"),
    ]
    from docketlake.operators.files import file_inventory, validate_upload

    df = spark.createDataFrame([(p, c, len(c)) for p, c, _ in rows], "path string, content binary, length long")
    got = {r["path"]: r["upload_error"] for r in validate_upload(df).collect()}
    assert got == {p: e for p, _, e in rows}
    marked = spark.createDataFrame(
        [("/b/v.txt", b"x" * 1_048_570 + b"EICAR-STANDARD-ANTIVIRUS-TEST-FILE", 1)], "path string, content binary, length long"
    )
    full = file_inventory(marked).first()
    assert full["scan_status"] == "infected"
    assert len(full["checksum"]) == 64


def test_plain_text_drops_bad_bytes(spark):
    df = spark.createDataFrame([(b"ab\xff\xfec\xc3\xa9" + b"z" * 4000,)], "content binary")
    text = df.select(files.plain_text(F.col("content")).alias("t")).first()["t"]
    assert text.startswith("abcé") and len(text) == 3000
