"""Substring deduplication by hashing lines, cut further at the ends of clauses, and joining repeated neighbours to passages."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

PASSAGE_WORDS, UNIT_WORDS = 20, 3
RUN_BYTES = 1 << 23
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A unit ends at a line break or behind a mark of the end of a clause that blanks follow; the blanks go with it, so units tile the text.
UNIT = r"[^\n.!?,;:]*(?:[.!?,;:]+[^ \t\r\n.!?,;:][^\n.!?,;:]*)*(?:[.!?,;:]*\n[ \t\r\n]*|[.!?,;:]+[ \t\r][ \t\r\n]*|[.!?,;:]*\z)"
#: What separates words; the rest of a unit is its normal form.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
_UNIT, _BETWEEN = re.compile(UNIT.replace(r"\z", r"\Z")), regex.compile(BETWEEN)


def text_units(text: str | None) -> tuple[list[str], list[str]]:
    """The units of a text, which joined give it back, and the normal form of each, empty for one without words."""
    found = [u for u in _UNIT.findall(text or "") if u]
    return found, [_BETWEEN.sub(" ", u.translate(LOWER)).strip(" ") for u in found]


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, digest, more, again)``: the units with words of each row of ``docs``, by a digest of 96 bits in two columns.

    ``place`` holds a hash of the text, which with ``doc_id`` names a row's content, and the number of the unit. Of
    units that repeat inside one stretch of the table only the one that ranks first keeps its digest; the others are known to be repeats
    (``again``) and get a digest of their own. So a unit that stands everywhere has one row per stretch.
    """
    names = ["doc_id", "place", "digest", "more", "again"]

    def ranked(doc_id, place: int) -> tuple:
        return (doc_id is not None, doc_id, place) if doc_id is not None else (False, place)

    def told(ids, row, place, raw, again):
        halves = np.frombuffer(b"".join(raw), np.dtype([("digest", "<i8"), ("more", "<i4")]))
        return pa.record_batch([ids.take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(halves["digest"]), pa.array(halves["more"]), pa.array(again, pa.bool_())], names=names)

    def run(batches):
        for batch in batches:
            ids, copies, texts = (batch.column(k).to_pylist() for k in range(3))
            row, place, raw, again, best, size = [], [], [], [], {}, 0
            for i, text in enumerate(texts):
                for k, unit in enumerate(text_units(text)[1]):
                    if unit:
                        digest = hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=12).digest()
                        at, here = copies[i] << 32 | k, len(row)
                        there = best.setdefault(digest, here)
                        if there != here:
                            if (ids[i], at) == (ids[row[there]], place[there]):
                                continue  # a row that repeats in whole
                            late = here
                            if ranked(ids[i], at) < ranked(ids[row[there]], place[there]):
                                best[digest], again[there], late = here, True, there
                        row.append(i)
                        place.append(at)
                        raw.append(digest)
                        again.append(there != here and late == here)
                        if there != here:
                            raw[late] = hashlib.blake2b(digest + repr((ids[row[late]], place[late])).encode("utf-8", "surrogatepass"), digest_size=12).digest()
                size += len(text or "")
                if size > RUN_BYTES or i + 1 == len(texts):
                    yield told(batch.column(0), row, place, raw, again)
                    row, place, raw, again, best, size = [], [], [], [], {}, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", copy_of("text").alias("copy"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, place bigint, digest bigint, more int, again boolean")


def copy_of(text: str) -> Column:
    """A hash of 31 bits that tells apart rows of one id."""
    return F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1)).cast("int")


def repeated_units(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy, again)``: per document the sorted numbers of the units that stand in an earlier place as well.

    Places rank by ``doc_id`` (null first), the text's hash, and unit number. All units meet by digest in one shuffle; the earliest
    place of each digest is kept, the others are repeats.
    """
    earlier = W.partitionBy("digest", "more").orderBy("doc_id", "place")
    # A row that repeats in whole has the same places twice: only the place that ranks first is no repeat.
    later = units(docs).withColumn("nth", F.dense_rank().over(earlier)).where("again or nth > 1")
    number = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return later.groupBy("doc_id", F.shiftright("place", 32).cast("int").alias("copy")).agg(F.array_sort(F.collect_set(number)).alias("again"))


def passages(text: str, again: np.ndarray, passage_words: int, unit_words: int) -> tuple[list[int], list[int], str]:
    """Begins and ends (code points) of the passages to cut out of ``text``, and what is left of it.

    A passage is a run of neighbouring units of ``again``, units without words between them included, in which the units
    of at least ``unit_words`` words hold ``passage_words`` words or more.
    """
    found, forms = text_units(text)
    edge = np.r_[0, np.cumsum([len(u) for u in found])]
    words = np.array([f.count(" ") + 1 if f else 0 for f in forms])
    named = np.flatnonzero(words)
    gone = np.isin(named, again)
    weight = np.where(words[named] >= unit_words, words[named], 0)
    step = np.diff(np.r_[0, gone.astype(np.int8), 0])
    begins, ends, kept, at = [], [], [], 0
    for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
        if weight[s:e].sum() >= passage_words:
            begin, end = int(edge[named[s]]), int(edge[named[e - 1] + 1])
            begins.append(begin)
            ends.append(end)
            kept.append(text[at:begin])
            at = end
    return begins, ends, "".join([*kept, text[at:]])


def without_repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """``docs`` with ``removed`` (the spans cut out, as offsets into the original text) and ``kept_text``.

    Units are lines, cut further behind the ends of sentences and clauses; case (A-Z) and all but letters and digits are ignored. A
    unit that an earlier place holds as well is a repeat. Neighbouring repeats are joined, and go if their units of ``unit_words`` words and
    more hold ``passage_words`` words together; shorter ones, such as common phrases, stay. A span takes the blanks and
    line breaks behind it along. The part of a passage that shares a clause with other text stays.

    Null texts have no units and a null ``kept_text``. Rows that repeat both id and text count as one document and are cut
    alike; a null id ranks first. Columns named ``removed`` or ``kept_text`` are replaced; other extra columns stay,
    whatever their names. An empty table gives an empty result.
    """
    extra = [c for c in docs.columns if c not in ("removed", "kept_text")]
    whole = docs.select(F.struct(*[docs[c] for c in extra]).alias("row"))
    found = repeated_units(docs).select(F.col("doc_id").alias("id"), "copy", "again")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (copy_of("row.text") == F.col("copy"))
    joined = whole.join(found, same, "left").select("row", "again")

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, again in zip(batch.column(0).field("text"), batch.column(1)):
                if text.is_valid and again.is_valid:
                    begins, ends, rest = passages(text.as_py(), again.values.to_numpy(), passage_words, unit_words)
                    spans.append([{"begin": b, "end": e} for b, e in zip(begins, ends)])
                    kept.append(rest)
                else:
                    spans.append([])
                    kept.append(text.as_py())
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, span), pa.array(kept, pa.string())], names=["row", "removed", "kept_text"])

    shape = StructType([joined.schema["row"]]).add("removed", ArrayType(StructType().add("begin", "integer").add("end", "integer"))).add("kept_text", "string")
    cut = joined.mapInArrow(run, shape)
    return cut.select("row.*", "removed", "kept_text")
