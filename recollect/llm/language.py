"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Bounds of the training sample: rows a language, bytes of a dictionary, bytes of all dictionaries (which are broadcast), languages.
ROWS, DICTIONARY, DICTIONARIES, LANGUAGES = 256, 1 << 16, 1 << 26, 8000
HASHES = 1 << 40
#: Texts are encoded in blocks, each with the dictionary at hand, so that all of a long text speaks.
BLOCK, LEVEL = 2048, 9
#: A prediction is accepted if it saves this share of what the next language needs.
MARGIN = 0.02
HOLD = 4
OTHER = re.compile(rb"[^a-z\x80-\xff]+")
UNKNOWN = "und"
FOUND = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def letters(text: str) -> bytes:
    """Lower-cased UTF-8 with a space for each run of ASCII characters other than letters."""
    return OTHER.sub(b" ", text.lower().encode("utf-8", "surrogatepass"))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD == 2


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw-content dictionaries by language, the most frequent first: pieces of at most ``rows`` texts that aren't held out,
    those with the least hash of id and text, each from a place in the text that the hash chooses. Fewer texts give longer
    pieces. The number of languages may not exceed ``LANGUAGES``; all dictionaries together stay under ``DICTIONARIES``."""
    train = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    train = train.withColumn("hash", F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES)))
    counts = train.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    size = min(size, DICTIONARIES // len(counts))
    # so that few more than the wanted rows are ordered in one task, those of larger hashes go first; the least always stays
    bounds = [(r["lang"], max(size // min(r["n"], rows), 1), max(min(HASHES, HASHES * (4 * rows + 64) // r["n"]), r["least"])) for r in counts]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, piece int, most long")
    near = train.join(F.broadcast(bounds), "lang").where("hash <= most")
    place = F.pmod("hash", F.greatest(F.length("text") - 2 * F.col("piece") + 1, F.lit(1))) + 1
    pieces = near.select("lang", "hash", "piece", F.substr("text", place.cast("int"), 2 * F.col("piece")).alias("text"))
    order = Window.partitionBy("lang").orderBy("hash", "text")
    chosen = pieces.withColumn("at", F.row_number().over(order)).where(F.col("at") <= rows).orderBy("lang", "at").collect()
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in chosen:
        piece = letters(r["text"])[: r["piece"]]
        if piece not in found[r["lang"]]:
            found[r["lang"]].append(piece)
    return {lang: b" ".join(pieces)[:size] for lang, pieces in found.items()}


class Encoders:
    """One compressor a language."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, block: int = BLOCK) -> None:
        self.block, self.all = block, []
        for lang, content in contents.items():
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=level)
            self.all.append((lang, zstandard.ZstdCompressor(level=level, dict_data=given, write_checksum=False, write_content_size=False, write_dict_id=False)))

    def sizes(self, text: str) -> list[int]:
        code = letters(text)
        blocks = [code[at : at + self.block] for at in range(0, len(code), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for _, c in self.all]

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score; the earlier of languages that tie."""
        if not self.all or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        ranked = sorted(zip(self.sizes(text), range(len(self.all))))
        best, at = ranked[0]
        return self.all[at][0], 1 - best / ranked[1][0] if len(ranked) > 1 else 1.0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, size: int = DICTIONARY, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row, learned from those that aren't held out.

    lang_pred is the language that encodes the whole text in the fewest bytes; score is the share that it saves of what the
    next language needs (1 if there is only one), and accepted says whether that is at least ``margin``, so that narrow
    cases can be rejected. Ties go to the language with more training rows, then the smaller name.

    Null texts and those without a letter are ``und`` with score 0 and not accepted; so is every text if there is nothing to
    learn from. A null id isn't held out. Rows with a null language teach nothing. Repeated rows each give a row, equal
    pieces enter a dictionary once. Other columns are ignored; an empty table gives no rows. After the bounded sample
    there is one pass over the texts without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, id_col, text_col, lang_col, rows, size))

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(shared.value, level)
        for part in slices(batches):
            found = [encoders.classify(t) for t in part.column(2).to_pylist()]
            langs, scores = [lang for lang, _ in found], [score for _, score in found]
            accepted = [lang != UNKNOWN and score >= margin for lang, score in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text")).mapInArrow(predicted, FOUND)
