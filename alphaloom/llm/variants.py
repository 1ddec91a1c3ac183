"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

``vocabulary`` counts the words of whole texts. ``neighbours`` finds all pairs of words that differ
by exactly one inserted, deleted or replaced code point. A word's letters, each with its
occurrence number, are a binary vector; one edit changes at most two of its places. The places are
dealt to ``PARTS`` parts by a fixed hash. Two vectors that differ in at most two places agree on
all parts but two, so each word has one signature for each choice of two parts that are left out:
the contents of the others. Words are equi-joined by signature and verified, so no pair is lost
and none is wrong. A signature that many words share is dealt again by the words' ends: an edit
leaves the first three or the last three code points of a word of six or more as they are.

``forms`` gives each word its usual form, a neighbour that is ``RATIO`` times as frequent, and
the root that forms lead to. Forms grow strictly in number, so pointers double until they rest.

Defined results: null and empty texts have no words; a null id is written as the empty text in
the checksum that strikes letters; repeated rows count each; very long texts are read whole; an
empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import stored

#: Of these many parts, two are left out of each signature: 21 signatures a word.
PARTS = 7
KEPT = list(itertools.combinations(range(PARTS), PARTS - 2))
#: Words that share a signature before they are dealt again by their ends, and the ends' length.
CROWD = 200
END = 3
#: Least code points and occurrences of a word, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
STRIKE = 199
#: Distinct words that a task counts before it hands them on.
HELD = 300_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def noisy(doc_id: object, run: str) -> str:
    """A lower-cased run as it is counted: by checksum of id and run, some lose a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % STRIKE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if (raw := data.as_py()) is None:
                continue
            # On bytes only A-Z are lower-cased.
            for run, n in Counter(_RUN.findall(raw.lower().decode("utf-8", "replace"))).items():
                if len(run) < LEAST_LENGTH:  # a struck one is shorter still
                    continue
                word = noisy(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


@functools.lru_cache(maxsize=100_000)
def _place(letter: str, occurrence: int) -> tuple[int, str]:
    """The part that a place of the vector is dealt to, and its name."""
    name = f"{letter}{occurrence} "
    return zlib.crc32(name.encode()) % PARTS, name


def signatures(word: str) -> list[int]:
    """A hash for each choice of parts that are kept: the kept parts' places."""
    parts, last, occurrence = [""] * PARTS, "", 0
    for letter in sorted(word):
        occurrence = occurrence + 1 if letter == last else 0
        last = letter
        part, name = _place(letter, occurrence)
        parts[part] += name
    return [xxhash.xxh64_intdigest("|".join([parts[p] for p in kept]), seed=k) - (1 << 63) for k, kept in enumerate(KEPT)]


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signatures(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["word", "signatures"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of distinct words, of six code points or more, that are one edit apart."""
    signed = words.select("word").mapInArrow(_signature_batches, "word string, signatures array<long>")
    dealt = stored(signed.select("word", F.explode("signatures").alias("signature")), "variants-signatures")
    counts = dealt.groupBy("signature").agg(F.count("*").alias("crowd")).where("crowd > 1")
    sized = dealt.join(counts, "signature")
    ends = F.array(F.xxhash64("signature", F.lit("first"), F.substring("word", 1, END)), F.xxhash64("signature", F.lit("last"), F.substring("word", -END, END)))
    keyed = stored(sized.select("word", F.explode(F.when(F.col("crowd") <= CROWD, F.array("signature")).otherwise(ends)).alias("key")), "variants-keys")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & near)
    pairs = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near")).distinct()
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.select(F.explode(both).alias("p")).select("p.word", "p.near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: each round, a word's pointer takes that of where it points."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n).

    The form is the neighbour of largest n, ties to the smallest in code-point order, if it has
    ``RATIO`` times the word's n or more.
    """
    words = stored(words.select("word", "n"), "variants-words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.col("form_n") >= RATIO * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(fits, F.col(c)).alias(c) for c in ("form", "form_n")))
    known = stored(known, "variants-forms")
    rooted = known.join(_roots(known.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their usual forms and roots."""
    return forms(vocabulary(df, doc_id, text))
