"""Language by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.runtime import top_per_group

from .held import held
from .inputs import prepared, unused

SAMPLE_DOCS = 1000
SAMPLE_CHARS = 1000
DICTIONARY_BYTES = 200_000
LEVEL = 6
CHUNK_BYTES = 4096
MIN_MARGIN = 0.002

_NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case runs of letters, one space between them."""
    return _NO_LETTER.sub(" ", text.lower()).strip()


def learn(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, sample_chars: int = SAMPLE_CHARS
) -> dict[str, bytes]:
    """A raw-content dictionary per language, most frequent language first.

    ``docs`` needs text and lang.  Rows where either is null are not learned
    from.  Each dictionary holds ``sample_chars`` characters each of at most
    ``sample_docs`` distinct texts, up to ``dictionary_bytes``: a bounded sample
    of the labelled rows.  Texts and the place in a text are picked by hash;
    shorter texts are taken whole.  No labelled rows: no languages.
    """
    labelled = docs.select("lang", "text").filter("lang is not null and text is not null")
    hashed = labelled.withColumn("pick", F.xxhash64("text"))
    counts = hashed.groupBy("lang", "pick").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    if not totals:
        return {}
    # hashes are even: those below a bound hold a few times the sample, so no task ranks a language
    share = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, 4.0 * sample_docs / r["texts"]))])
    low = F.pmod("pick", F.lit(1 << 40)) <= share[F.col("lang")] * float(1 << 40)
    wanted = top_per_group(counts.filter(low).select("lang", "pick"), ["lang"], [F.col("pick")], sample_docs).drop("rank")
    place = F.pmod(F.xxhash64("pick"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    sample = (
        hashed.join(F.broadcast(wanted), ["lang", "pick"])
        .groupBy("lang", "pick")
        .agg(F.min(F.substring("text", place, F.lit(sample_chars))).alias("text"))
        .toPandas()
    )
    sizes = {r["lang"]: r["n"] for r in totals}
    model = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        rows = sample[sample["lang"] == lang].sort_values("pick")
        held, total = [], 0
        for text in rows["text"]:
            held.append(plain(text))
            total += len(held[-1].encode()) + 1
            if total > dictionary_bytes:
                break
        model[lang] = " ".join(held).encode()[:dictionary_bytes]
    return model


class Compressors:
    """One compressor per language, built once in each task."""

    def __init__(self, model: dict[str, bytes], level: int):
        import zstandard

        self.tools = {}
        for lang, content in model.items():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self.tools[lang] = zstandard.ZstdCompressor(
                level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
            )

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes per language.  A long text goes in blocks, or its own words would take over from the dictionary's."""
        blocks = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self.tools.values()]


def predict(docs: DataFrame, model: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected (boolean).

    lang_pred is a learned language, or ``und`` with score 0 if the text is null
    or has no letter, or nothing was learned.  score is the share by which the
    best language's size is below the second's; with one language it is 1.
    Equal sizes: the language with more labelled rows.  rejected: ``und``, or a
    score below ``min_margin``.  Columns of these names are replaced.
    """
    prepared(docs.sparkSession)
    packed = pickle.dumps((model, level))
    names = list(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def classify(texts: pa.Array) -> pa.Array:
        tools = held(("language", packed), lambda: Compressors(*pickle.loads(packed)))
        langs, scores = [], []
        for text in texts.to_pylist():
            letters = plain(text or "")
            if not names or not any(map(str.isalpha, letters)):
                langs.append("und")
                scores.append(0.0)
                continue
            sizes = tools.sizes(letters.encode(errors="replace"))
            order = sorted(range(len(sizes)), key=sizes.__getitem__)
            langs.append(names[order[0]])
            scores.append(1.0 if len(sizes) == 1 else (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    given = docs.drop("lang_pred", "score", "rejected")
    told = unused(docs, "language")[0]
    return (
        given.withColumn(told, classify(F.col("text").cast("string")))
        .withColumn("lang_pred", F.col(f"{told}.lang"))
        .withColumn("score", F.col(f"{told}.score"))
        .drop(told)
        .withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < min_margin))
    )


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents that is never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, **options) -> dict[str, bytes]:
    return learn(docs.filter(~held_out()), **options)
