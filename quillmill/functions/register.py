"""The detector and the splitter as SQL table functions, and the column functions a session's SQL may want."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill.functions import chunks, spans


def register(spark: SparkSession) -> None:
    """``detect_pii(text)`` and ``chunk(text, doc_type)`` as table functions, ``count_tokens(text)`` as a function."""
    patterns = {k: (re.compile(spans.marked(k)[0], re.ASCII), spans.RECOGNIZERS[k][1], spans.NEAR.get(k)) for k in spans.RECOGNIZERS}

    class DetectPii:
        def eval(self, text: str):
            for kind, (pattern, score, near) in patterns.items():
                more = near[1] if near and text and re.search(near[0], text) else 0.0
                for m in pattern.finditer(text or ""):
                    yield kind, m.start(2), m.end(2), min(score + more, 1.0), m.group(2)

    class Chunk:
        def eval(self, text: str, doc_type: str):
            if text is not None:
                size, overlap = chunks.CONFIG.get(doc_type, chunks.CONFIG["private"])
                separators = chunks.LEGAL_SEPARATORS if doc_type == "caselaw" else chunks.COMMON_SEPARATORS
                parts = chunks.Splitter(size, overlap, separators).places(text) or [(0, len(text), chunks.word_tokens(text))]
                for i, (a, b, n) in enumerate(parts):
                    yield text[a:b], i, len(parts), n

    spark.udtf.register("detect_pii", F.udtf(DetectPii, returnType="entity_type string, start int, end int, score double, found string"))
    spark.udtf.register("chunk", F.udtf(Chunk, returnType="text string, index int, total int, token_count int"))
    spark.udf.register("count_tokens", chunks.word_tokens, "int")
