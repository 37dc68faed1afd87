"""Places where a user's own model, detector or extractor runs.

A factory is called once per task and makes the callable, so a model is loaded
once and not per row; rows travel in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docketlake import fixed
from docketlake.functions.replies import parsed_reply


def score_documents(df: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Add ``answer``, the parsed reply of a text model.

    The callable gets the document text and returns its raw reply.  Empty texts and
    failing calls give an empty answer, so the rules decide those documents.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory()

        def reply(text: str | None) -> str:
            if not text:
                return ""
            try:
                return predict(text) or ""
            except Exception:
                return ""

        for batch in batches:
            yield batch.assign(reply=[reply(t) for t in batch["text"]])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    replied = df.mapInPandas(run, f"{columns}, reply string")
    return replied.withColumn("answer", parsed_reply(F.col("reply"))).drop("reply")


def detect_on_pages(
    images: DataFrame, factory: Callable[[], Callable[[bytes], Iterable[Any]]],
    threshold: float = fixed.VISUAL_MIN_CONFIDENCE, source: str = "rfdetr",
) -> DataFrame:
    """Detections of a visual model, one row each.

    ``images``: doc_id, page (absolute, from 0), image.  The callable yields
    ``(confidence, (x1, y1, x2, y2))``; those below ``threshold`` are left out.  A
    failing page gives one row with the error and no detection.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for batch in batches:
            rows = []
            for doc_id, page, image in zip(batch["doc_id"], batch["page"], batch["image"]):
                try:
                    found = list(detect(image))
                except Exception as failure:
                    rows.append((doc_id, page, None, None, None, source, str(failure)))
                    continue
                for seq, (confidence, box) in enumerate(found):
                    if confidence >= threshold:
                        rows.append((doc_id, page, seq, round(float(confidence), 4),
                                     [round(float(v), 2) for v in box], source, None))
            frame = pd.DataFrame(rows, columns=["doc_id", "page", "seq", "confidence", "bbox", "source", "error"])
            yield frame.astype({"seq": "Int32", "confidence": "Float64"})

    return images.select("doc_id", "page", "image").mapInPandas(
        run, "doc_id long, page int, seq int, confidence double, bbox array<double>, source string, error string"
    )


def extract_pages_with(
    files: DataFrame, factory: Callable[[], Callable[[bytes], Iterable[str]]]
) -> DataFrame:
    """Page texts of files: ``(doc_id, page_no, text, error)``.

    The callable yields the text of each page.  A file it cannot read gives one row
    with the error and no page number.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = factory()
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    texts = list(extract(content))
                except Exception as failure:
                    rows.append((doc_id, None, None, str(failure)))
                    continue
                rows.extend((doc_id, n, text or "", None) for n, text in enumerate(texts, start=1))
            frame = pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "error"])
            yield frame.astype({"page_no": "Int32"})

    return files.select("doc_id", "content").mapInPandas(
        run, "doc_id long, page_no int, text string, error string"
    )
