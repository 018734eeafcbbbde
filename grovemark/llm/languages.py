"""Language identification by compression.

Each language of the labelled documents has a raw-content zstandard dictionary: whole texts of a bounded sample of its
documents, reduced to lower-case words. A text, reduced in the same way, is compressed once with each dictionary; the
language whose dictionary leaves the fewest bytes is chosen. The margin is the share by which the second smallest size is
larger; a margin below `min_margin` is reported as rejected, beside the best guess.

The sample is the `sample_rows` documents of each language with the smallest hash of text and id, cut to `dictionary_bytes`
in all; so the driver needs no more text of a language than whole texts of four times that many characters, and one more.
Languages are counted over all training rows. Letters are the characters for which str.isalpha() holds; all others part words, combining marks too. Scoring is a pass over the texts without a shuffle.

Defined cases: a text that is null or without a letter is `und` with score 0; rows without a language teach nothing; where
sizes tie the language with more training rows, then the smaller name, is chosen; without training rows all is `und`;
rows that repeat and null ids are rows like others; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LANGUAGES = 500  # dictionaries that a task can hold
NOT_A_LETTER = re.compile(r"[\W\d_]+")
# Word characters that are no letters either: numbers of other kinds, such as fractions and numerals.
NUMBERS = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
AS_SPACES = dict.fromkeys(map(ord, NUMBERS), " ")


def reduced(text: str) -> bytes:
    """Lower-case words of letters with one space between them and at both ends."""
    text = text.lower()
    if not text.isascii() and not NUMBERS.isdisjoint(text):
        text = text.translate(AS_SPACES)
    return f" {NOT_A_LETTER.sub(' ', text).strip()} ".encode()


def sampled_texts(docs: DataFrame, text: str, lang: str, sample_rows: int, dictionary_bytes: int) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Training rows of each language, and the texts of its sample, at most sample_rows for each."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[lang]: row["n"] for row in labelled.groupBy(lang).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return counts, []
    # Before anything is ranked, each language is thinned to about four times its sample by the hash.
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 4 * sample_rows / n))))
    h = F.pmod(F.xxhash64(F.col(text), F.lit("sample")), F.lit(1 << 40))
    thin = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h")).filter(
        F.col("h") < F.element_at(share, F.col("lang")) * F.lit(1 << 40)
    )
    distinct = thin.dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = distinct.withColumn("place", place).filter(F.col("place") <= sample_rows)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h")) - F.length("text")
    rows = chosen.withColumn("before", before).filter(F.col("before") < 4 * dictionary_bytes).orderBy("lang", "h").select("lang", "text")
    return counts, [(row["lang"], row["text"]) for row in rows.collect()]


def dictionaries(texts: list[tuple[str, str]], dictionary_bytes: int) -> dict[str, bytes]:
    """The raw content of each language's dictionary."""
    out: dict[str, bytes] = {}
    for lang, text in texts:
        if len(out.get(lang, b"")) < dictionary_bytes:
            out[lang] = out.get(lang, b"") + reduced(text)
    return {lang: content[:dictionary_bytes] for lang, content in out.items() if content.strip()}


def identify(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int = 300, dictionary_bytes: int = 200_000, level: int = 3, min_margin: float = 0.02, carry: list[str] | None = None,
) -> DataFrame:
    """(key, *carry, lang_pred, score, rejected): score is the best language's share when sizes are weighed by the
    likelihood that they stand for. Rows for which `train` holds teach; all rows are scored.
    """
    counts, texts = sampled_texts(docs.filter(train), text, lang, sample_rows, dictionary_bytes)
    contents = dictionaries(texts, dictionary_bytes)
    names = sorted(contents, key=lambda name: (-counts[name], name))
    shared = docs.sparkSession.sparkContext.broadcast([contents[name] for name in names])
    columns = [key, *(carry or [])]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = []
        for content in shared.value:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False))
        for batch in batches:
            out = []
            for value in batch.column(len(columns)):
                body = reduced(value.as_py() or "")
                if not compressors or not body.strip():
                    out.append(("und", 0.0, True))
                    continue
                sizes = [len(c.compress(body)) for c in compressors]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                weights = [2.0 ** max(-60, sizes[best] - s) for s in sizes]
                out.append((names[best], 1 / math.fsum(weights), second - sizes[best] < min_margin * sizes[best]))
            preds, scores, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*columns, "lang_pred", "score", "rejected"],
            )

    kept = docs.select(*columns, F.col(text).cast("string"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes[:-1])
    return kept.mapInArrow(scored, f"{kinds}, lang_pred string, score double, rejected boolean")
