"""Benchmark decontamination: test n-grams as a hash set, looked up in every window of a document.

Main path: SQL functions alone.  Words are runs of non-ASCII characters, digits and a-z after
A-Z are lower-cased.  A gram is ``SIZE`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one gram.  Every window is probed by the hash of three of its words (first, middle,
last) alone; only where a gram has that hash is the window put together.  Up to ``SET_MAX`` grams of
``SET_BYTES`` go to the executors as sets of probe hashes and texts inside the scan, and a probed window is
compared as text, so a hash collision is no hit.  More grams than that are never broadcast: the probe
is then a table of ``2**PROBE_BITS`` bits, of fixed size, and only windows that it lets through leave
the scan, to be joined to the grams as text.

Null and empty texts have no words and no hits; null or empty items have no grams.  Repeated rows
each give their own result; repeated items count once.  Null item ids don't count as items.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import ascii_lower, checkpointed, few_files, first_only, let

SIZE, SET_MAX, SET_BYTES, PROBE_BITS = 13, 100_000, 16 << 20, 23
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def gram(of: Column, at: Column, size: int) -> Column:
    return F.slice(of, at, F.lit(size))


def item_grams(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(item, n, gram): the distinct windows of every item, words joined by spaces."""
    w = first_only(benchmark, item, text).select(F.col(item).alias("item"), words(F.col(text)).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    return w.select("item", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(w.w, i, w.n), " "))).alias("gram")).distinct()


def probe(w: Column, at, n: int) -> Column:
    """A hash of the first, middle and last of the n words from place ``at``, counted from 0."""
    return F.xxhash64(F.lit(n), *[F.get(w, at + i) for i in sorted({0, n // 2, n - 1})])


class Lookup:
    """What the scan asks of a benchmark: its grams themselves, or, of more than may be broadcast, a table of bits."""

    def __init__(self, grams: DataFrame):
        distinct = grams.select("n", "gram").distinct()
        self.sizes = sorted(r.n for r in distinct.select("n").distinct().collect())  # SIZE of them at most
        count, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
        hashed = [distinct.filter(F.col("n") == n).select("n", "gram", probe(F.split("gram", " "), F.lit(0), n).alias("h")) for n in self.sizes]
        self.exact = count <= SET_MAX and size <= SET_BYTES
        if self.exact:
            self.sets = {n: sorted((r.h, r.gram) for r in rows.collect()) for n, rows in zip(self.sizes, hashed)}
        else:
            all_hashes = hashed[0]
            for more in hashed[1:]:
                all_hashes = all_hashes.unionAll(more)
            self.bits = self._table(all_hashes)

    @staticmethod
    def _place(h: Column) -> tuple[Column, Column]:
        """Which number of the table, and which bit of it."""
        bit = F.pmod(h, F.lit(1 << PROBE_BITS))
        return F.shiftright(bit, 6).cast("int"), (bit % 64).cast("int")

    def _table(self, hashes: DataFrame) -> Column:
        word, bit = self._place(F.col("h"))
        rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()
        table = [0] * (1 << (PROBE_BITS - 6))
        for r in rows:
            table[r.word] = r.bits
        return F.from_json(F.lit(json.dumps(table)), "array<bigint>")  # a constant of the plan

    def has(self, w: Column, i: Column, n: int) -> Column:
        """Whether the n words from place i (from 1) are a gram, or, with a table of bits, may be one."""
        h = probe(w, i - 1, n)
        if self.exact:
            return h.isin([x[0] for x in self.sets[n]]) & F.array_join(gram(w, i, n), " ").isin([x[1] for x in self.sets[n]])
        return let(h, lambda h: F.getbit(F.get(self.bits, self._place(h)[0]), self._place(h)[1]) == 1)

    def windows(self, w: Column) -> Column:
        """Array of (at, n, gram): the windows of words ``w`` that are grams, or may be."""

        def of(n: int) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.lit([]).cast("array<int>"))
            at = F.filter(starts, lambda i: self.has(w, i, n))
            return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(gram(w, i, n), " ").alias("gram")))

        return F.concat(F.lit([]).cast("array<struct<at:int,n:int,gram:string>>"), *map(of, self.sizes))


def covered(hits: Column) -> Column:
    """Places of the words that windows (at, n) cover, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SIZE) -> DataFrame:
    """For every row of ``docs``: ``keep``, n_words, hit_at (places of hit words, from 1), items (ids, as sorted strings).

    The scan's results, without texts, are written to the shared folder once; only rows with hits
    are then joined to the items that hold their grams.
    """
    grams = checkpointed(few_files(item_grams(benchmark, size=size)))
    known = Lookup(grams)
    row = F.monotonically_increasing_id().alias("_row")
    names = [f"_k{i}" for i in range(len(keep))]
    both = lambda w: F.struct(F.size(w).alias("n_words"), known.windows(w).alias("hits"))
    rows = docs.select(row, *[docs[c].alias(n) for c, n in zip(keep, names)], let(words(docs[text]), both).alias("_scan")).select("_row", *names, "_scan.*")
    if known.exact:
        own = F.array_distinct(F.transform("hits", lambda h: h["gram"]))
        rows = checkpointed(rows.select("_row", *names, "n_words", covered(F.col("hits")).alias("hit_at"), own.alias("_grams")))
        hits = rows.filter(F.size("_grams") > 0).select("_row", F.explode("_grams").alias("gram"))
    else:
        rows = checkpointed(rows)
        maybe = rows.filter(F.size("hits") > 0).select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
        found = checkpointed(maybe.join(grams.select("gram").distinct(), "gram"))
        by_row = found.groupBy(F.col("_row").alias("_r")).agg(covered(F.collect_set(F.struct("at", "n"))).alias("hit_at"))
        rows = rows.join(by_row, F.col("_row") == F.col("_r"), "left").select("_row", *names, "n_words", F.coalesce("hit_at", F.lit([]).cast("array<int>")).alias("hit_at"))
        hits = found.select("_row", "gram").distinct()
    of_item = grams.filter(F.col("item").isNotNull()).select("gram", F.col("item").cast("string").alias("item"))
    items = hits.join(of_item, "gram").select("_row", "item").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.join(items, "_row", "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "hit_at", F.coalesce("items", F.lit([]).cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: at least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str, size: int) -> tuple[list[str], DataFrame]:
    """(names of the columns of ``docs``, ``docs`` as _c0, _c1, ..., with _text, n_words and hit_at)."""
    names = docs.columns
    rows = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(names)], docs[text].alias("_text"))
    known = Lookup(checkpointed(few_files(item_grams(benchmark, size=size))))
    if known.exact:
        both = lambda w: F.struct(F.size(w).alias("n_words"), covered(known.windows(w)).alias("hit_at"))
        return names, rows.select("*", let(words(F.col("_text")), both).alias("_scan")).select(*rows.columns, "_scan.*")
    # Hits depend on the text alone: each distinct one is scanned once.
    rows = rows.withColumn("_digest", F.md5(F.coalesce("_text", F.lit(""))))
    texts = rows.select(F.col("_digest").alias("doc_id"), "_text").dropDuplicates(["doc_id"])
    hits = scan(texts, benchmark, "_text", size=size).select(F.col("doc_id").alias("_of"), "n_words", "hit_at")
    return names, rows.join(hits, F.col("_digest") == F.col("_of")).drop("_digest", "_of")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; one pass without a shuffle where the grams are sets of the scan."""
    names, rows = with_hits(docs, benchmark, text, size)
    return rows.filter(~contaminated(F.size("hit_at"), F.col("n_words"))).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with every hit word cut from its text, along with the break after it."""
    names, rows = with_hits(docs, benchmark, text, size)
    plain = F.coalesce("_text", F.lit(""))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    breaks, own = F.split(plain, word), F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")

    def rest(v: Column) -> Column:
        kept = F.transform(F.sequence(F.lit(1), F.size(v["own"])), lambda i: F.when(F.array_contains(v["hit"], i), "").otherwise(F.concat(F.get(v["own"], i - 1), F.get(v["breaks"], i))))
        return F.concat(F.get(v["breaks"], F.lit(0)), F.array_join(kept, ""))

    parts = F.struct(own.alias("own"), breaks.alias("breaks"), F.col("hit_at").alias("hit"))
    cut = F.when(F.col("_text").isNull() | (F.size("hit_at") == 0), F.col("_text")).otherwise(let(parts, rest))
    return rows.select(*[(cut if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)])
