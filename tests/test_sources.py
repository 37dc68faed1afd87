"""File sources, sinks and the hooks for user callables."""

import json

import pytest
from pyspark.sql import functions as F

from docketlake import hooks
from docketlake.operators import files as file_jobs
from docketlake.operators import intake
from docketlake.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in box"
    for name, content in {
        "Acme Corp/a.txt": b"Statement of Work\xff", "Acme Corp/deep/b.PDF": b"%PDF-1.4", "Acme Corp/skip.exe": b"MZ",
        "_work/c.txt": b"x", ".hidden/d.txt": b"x", "Globex/e.docx": b"PK", "top.txt": b"no vendor",
    }.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    return str(root)


def test_folder_scan(spark, tree):
    rows = files.read_document_files(spark, tree).select("folder", "original_name").collect()
    assert sorted(map(tuple, rows)) == [("Acme Corp", "a.txt"), ("Acme Corp", "b.PDF"), ("Globex", "e.docx")]
    text = files.read_text_documents(spark, tree).collect()
    assert [(r["folder"], r["text"]) for r in text] == [("Acme Corp", "Statement of Work")]
    counts = file_jobs.count_files_by_extension(files.read_document_files(spark, tree)).collect()
    assert dict(map(tuple, counts)) == {".txt": 1, ".pdf": 1, ".docx": 1}


def test_registry_reading(spark, tmp_path):
    entries = [
        {"tracking_id": "T1", "vendor": "Acme", "document_type": "MSA", "filename": "a.pdf", "expiration_date": "2025-01-01", "retention_category": "contracts", "contract_value": 5},
        {"tracking_id": "T2", "vendor": "B", "document_type": "NDA", "filename": "b.pdf", "expiration_date": None, "retention_category": "indefinite"},
    ]
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"total_documents": 2, "expiration_tracking": entries}, indent=2))
    bad = tmp_path / "bad.json"
    bad.write_text("not json")
    assert [r["tracking_id"] for r in files.read_registry(spark, str(good)).collect()] == ["T1", "T2"]
    assert files.read_registry(spark, str(bad)).count() == 0
    assert files.read_registry(spark, str(tmp_path / "missing.json")).count() == 0


def test_blank_lines_in_labels(spark, tmp_path):
    file = tmp_path / "labels.jsonl"
    file.write_text('{"text": "t", "doc_type": "MSA", "vendor": "A", "is_default": false, "source": "regex"}\n\n \n')
    rows = files.read_pseudo_labels(spark, str(file)).where("text is not null").collect()
    assert [r["doc_type"] for r in rows] == ["MSA"]


def test_publishing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a b.pdf", "old"), (2, "b?.pdf", "old")], "doc_id long, new_filename string, v string")
    second = spark.createDataFrame([(2, "b?.pdf", "new")], "doc_id long, new_filename string, v string")
    sinks.publish_results(first, path, 0)
    for _ in range(2):
        sinks.publish_results(second, path, 1)
    assert spark.read.parquet(path).count() == 3
    got = {r["doc_id"]: (r["v"], r["location"]) for r in sinks.read_published(spark, path).collect()}
    assert got == {1: ("old", "results/1/a_b.pdf"), 2: ("new", "results/2/b_.pdf")}


def test_tracking_ids_are_stable(spark):
    from docketlake.functions.naming import tracking_id

    row = spark.range(1).select(
        tracking_id(F.lit("A"), F.lit("MSA"), F.lit("/p")).alias("x"), tracking_id(F.lit("A"), F.lit("MSA"), F.lit("/p")).alias("y")
    ).first()
    assert row["x"] == row["y"] and row["x"].startswith("A_MSA_") and len(row["x"]) == 10


def test_model_hook_falls_back(spark):
    def factory():
        def predict(text):
            if "boom" in text:
                raise ValueError("boom")
            return '{"doc_type": "NDA", "vendor": "Told Inc"}'

        return predict

    docs = spark.createDataFrame([
        (1, "/x/1", "Folder Co", "a_MSA.txt", "some text"), (2, "/x/2", "Globex", "b.txt", "boom: purchase order"), (3, "/x/3", "", "Initech_SOW.txt", ""),
    ], "doc_id long, path string, folder string, original_name string, text string")
    out = {r["doc_id"]: r for r in intake.analyze_documents(hooks.score_documents(docs, factory)).collect()}
    assert (out[1]["document_type"], out[1]["vendor"], out[1]["clean_vendor"]) == ("NDA", "Told Inc", "ToldInc")
    assert (out[2]["document_type"], out[2]["vendor"]) == ("PO", "globex")
    assert (out[3]["document_type"], out[3]["vendor"]) == ("SOW", "Initech")


def test_extractor_and_detector_hooks(spark):
    def extractor():
        def pages(content):
            if content == b"bad":
                raise ValueError("PDF could not be parsed")
            return content.decode().split("|")

        return pages

    raw = spark.createDataFrame([(1, b"one|digitally signed by Jane"), (2, b"bad")], "doc_id long, content binary")
    rows = hooks.extract_pages_with(raw, extractor).collect()
    assert {(r["doc_id"], r["page_no"], r["text"], r["error"]) for r in rows} == {
        (1, 1, "one", None), (1, 2, "digitally signed by Jane", None), (2, None, None, "PDF could not be parsed"),
    }

    def detector():
        def find(image):
            if image == b"bad":
                raise ValueError("no image")
            return [(0.34999, (0, 0, 1, 1)), (0.912345, (1.234, 2, 3, 4.567))]

        return find

    images = spark.createDataFrame([(1, 4, b"img"), (1, 5, b"bad")], "doc_id long, page int, image binary")
    found = sorted(hooks.detect_on_pages(images, detector).collect(), key=lambda r: r["page"])
    assert [(r["page"], r["seq"], r["confidence"], r["bbox"], r["error"]) for r in found] == [
        (4, 1, 0.9123, [1.23, 2.0, 3.0, 4.57], None), (5, None, None, None, "no image")]


def test_whole_chain_from_pages(spark):
    """Front pages decide the type, tail pages the status, failures go to the error folder."""
    docs = spark.createDataFrame([
        (1, "/x/1", "Acme Corp", "scan.pdf", None), (2, "/x/2", "Acme Corp", "scan.pdf", None), (3, "/x/3", "Acme Corp", "broken.pdf", "PDF could not be parsed"),
        (4, "/x/4", "Other", "broken.pdf", "PDF could not be parsed"),
    ], "doc_id long, path string, folder string, original_name string, error string")
    pages = spark.createDataFrame([
        (1, 1, "Master Service Agreement"), *[(1, n, "filler page") for n in range(2, 9)], (1, 9, "DocuSign Envelope ID: 5"),
        (2, 1, "Master Service Agreement digitally signed by Jo"), *[(2, n, "filler page") for n in range(2, 9)],
    ], "doc_id long, page_no int, text string")
    full = intake.with_page_texts(docs, pages)
    analysed = {r["doc_id"]: r for r in intake.analyze_documents(full).collect()}
    assert analysed[1]["document_type"] == "MSA" and analysed[1]["execution_status"] == "final"
    assert analysed[2]["execution_status"] == "supporting"  # the signature is not on the last pages
    assert analysed[3]["error"] and analysed[3]["document_type"] is None
    plan = {r["doc_id"]: r["resolved_path"] for r in intake.process_folders(full).collect()}
    assert plan == {
        1: "Acme Corp/Acme Corp_final/AGMT_Acmecorp_masterServiceAgreement_001.pdf",
        2: "Acme Corp/Acme Corp_supporting/AGMT_Acmecorp_masterServiceAgreement_002.pdf",
        3: "_errors/broken.pdf", 4: "_errors/broken_conflict01.pdf",
    }


def test_metadata_json(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "/x/1", "Acme Corp", "a.txt", "Purchase order, expires 1/2/2030")],
        "doc_id long, path string, folder string, original_name string, text string",
    )
    sinks.write_metadata(intake.analyze_documents(docs), str(tmp_path / "m"))
    told = json.loads(spark.read.text(str(tmp_path / "m")).first()["value"])
    assert told["document_type"] == "PO" and told["retention_category"] == "short_term"
    assert told["date_metadata"]["expiration_date"] == "2030-01-02" and told["tracking_id"].startswith("acme corp_PO_")


def test_spread_deals_rows_not_partitions(spark, tmp_path, monkeypatch):
    """A scan with many partitions, all rows in one of them, as of a file with one row group."""
    from docketlake.sources import tables

    monkeypatch.setattr(tables, "SPREAD_ROWS", 1000)
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    settings = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        scan = spark.read.parquet(str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() >= 4
        sizes = tables.spread(scan).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 20_000 and max(sizes) <= 1500


def test_wide_contracts_are_dealt_after_their_join(spark, tmp_path, monkeypatch):
    from docketlake.plans.views import Data
    from docketlake.sources import tables

    monkeypatch.setattr(tables, "SPREAD_ROWS", 50)
    spark.range(20).selectExpr(
        "id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 5 as int) as c_nationkey",
    ).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1000).selectExpr(
        "id as o_orderkey", "id % 20 as o_custkey", "'F' as o_orderstatus", "timestamp '1998-02-06 00:00:00' as o_orderdate",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    data = Data(spark, str(tmp_path))
    wide = data.wide.contracts
    assert wide.rdd.getNumPartitions() == 21
    assert wide.columns == data.contracts.columns
    assert wide.exceptAll(data.contracts).isEmpty() and wide.count() == data.contracts.count() == 1000


def test_text_files_of_one_folder(spark, tmp_path):
    """A file for every pair, its lines in order; a folder for every vendor and none for a file."""
    rows = [("Acme", 1, 2, "b"), ("Acme", 1, 1, "a�"), ("Acme", 2, 3, None), ("a/b: c%", 1, 4, "x"), (None, 1, 5, "n"), ("", 1, 6, "e")]
    rows += [("many", n // 10, n, f"line {n}") for n in range(3000)]
    df = spark.createDataFrame(rows, "source string, part long, doc_id long, value string")
    path = str(tmp_path / "texts")
    sinks.write_text_files(df, path, "source", "part", ["doc_id", "value"])
    found = {(r["folder"], r["original_name"]): r["text"] for r in files.read_text_documents(spark, path).collect()}
    many = {("source=many", f"part={k}.txt"): "".join(f"line {n}\n" for n in range(10 * k, 10 * k + 10)) for k in range(300)}
    assert found == many | {
        ("source=Acme", "part=1.txt"): "a\nb\n", ("source=Acme", "part=2.txt"): "\n", ("source=a%2Fb%3A c%25", "part=1.txt"): "x\n",
        ("source=__HIVE_DEFAULT_PARTITION__", "part=1.txt"): "n\ne\n"}
    assert sorted(p.name for p in (tmp_path / "texts").iterdir()) == [
        "source=Acme", "source=__HIVE_DEFAULT_PARTITION__", "source=a%2Fb%3A c%25", "source=many"]
    assert not [p for p in (tmp_path / "texts").rglob("*") if p.is_dir() and p.parent.name.startswith("source=")]
    # the same names as those of Spark's own writer
    df.where("source = 'a/b: c%'").select("source", "value").write.partitionBy("source").text(str(tmp_path / "spark"))
    assert [p.name for p in (tmp_path / "spark").glob("source=*")] == ["source=a%2Fb%3A c%25"]
