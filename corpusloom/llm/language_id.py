"""Language identification by compression.

For each language a raw-content dictionary is cut from a sample of its texts. A text is encoded with each of them by zstandard, and
the language whose dictionary gives the smallest total is chosen. What is encoded are the letters of the whole text, ASCII ones in
lower case, everything else a blank; in blocks, so that the dictionary and not the text's own beginning serves as context
throughout. Short texts, where a byte decides, are encoded at a higher level with four dictionaries of each language, whose sizes
are added. A margin to the second language that is narrow, as a share of the size, is a rejection.

Bounds: a dictionary holds ``dict_bytes``, all of them together MODEL_BYTES; they are made from ``max_train`` distinct texts of a
language at most, those with the least hashes, and ``piece`` code points of each. Nothing else is bounded: every text is encoded whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as are all where no language was learned; of equal
totals the first language in code-point order is taken, with the score shared; repeated rows get equal results; rows without lang
teach nothing; a null doc_id counts as an empty text in the hash; an empty table gives an empty result. Extra columns do not
matter."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_mod, materialise

#: Bytes of all dictionaries together.
MODEL_BYTES = 64 << 20
BLOCK, SHORT, LEVEL, SHORT_LEVEL, PARTS = 4096, 200, 5, 12, 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case; bytes beyond ASCII as they are; all else blanks.
_PLAIN = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.encode().translate(_PLAIN).split())


def fit(docs: DataFrame, learn: Column | None = None, dict_bytes: int = 112 << 10, max_train: int = 800, piece: int = 2000) -> dict[str, list[bytes]]:
    """Dictionaries for each language (lang) of the documents for which ``learn`` holds, PARTS of each. Texts of which there are copies count once."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (learn if learn is not None else F.lit(True)))
    texts = materialise(known.select("lang", F.xxhash64("text").alias("h")).distinct(), "language-texts")
    # Hashes are even, so the least ones of a language are taken from a share of them, which only a few times max_train have. A row for each
    # language is sent, as many as the model has.
    share = texts.groupBy("lang").agg((4.0 * max_train / F.count("*")).alias("share"))
    low = texts.join(F.broadcast(share), "lang").where(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
    picked = low.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= max_train).select("lang", "h")
    rows = known.select("lang", F.xxhash64("text").alias("h"), F.left("text", F.lit(piece)).alias("piece")).join(picked, ["lang", "h"])
    sample = rows.groupBy("lang", "h").agg(F.min("piece").alias("piece")).orderBy("lang", "h")
    pieces: dict[str, list[bytes]] = {}
    for r in sample.toLocalIterator():  # max_train pieces of a language
        if p := letters(r["piece"]):
            pieces.setdefault(r["lang"], []).append(p)
    most = min(dict_bytes, MODEL_BYTES // (PARTS * max(1, len(pieces))))
    return {k: [b" ".join(v[i::PARTS] or v)[:most] for i in range(PARTS)] for k, v in sorted(pieces.items())}


class _Encoder:
    """Compressors of one level with the first ``parts`` dictionaries of each language."""

    def __init__(self, model: dict[str, list[bytes]], level: int, parts: int):
        def one(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.each = [[one(content) for content in contents[:parts]] for contents in model.values()]

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks for c in some) for some in self.each]


def _choose(names: list[str], sizes: list[int], margin: float) -> tuple[str, float, bool]:
    """Language, score and rejection: the score is the language's part of weights that fall by e for each percent of size."""
    best = min(sizes)
    unit = max(1.0, best / 100)
    score = 1 / sum(math.exp((best - s) / unit) for s in sizes)
    second = sorted(sizes)[1] if len(sizes) > 1 else math.inf
    return names[sizes.index(best)], score, second - best < margin * best


def identify(docs: DataFrame, model: dict[str, list[bytes]], margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score and rejected (the margin is narrow, or there is nothing to judge) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = list(sent.value)
        long, short = _Encoder(sent.value, LEVEL, 1), _Encoder(sent.value, SHORT_LEVEL, PARTS)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py()
                if not names or text is None or not _LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                data = b" " + letters(text) + b" "
                out.append(_choose(names, (short if len(data) <= SHORT else long).sizes(data), margin))
            pred, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, 4) == 2


def languages(docs: DataFrame, margin: float = 0.01) -> DataFrame:
    """identify() for all documents, learned from those that are not held out, with held_out."""
    model = fit(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model, margin).withColumn("held_out", held_out(F.col("doc_id")))
