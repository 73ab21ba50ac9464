"""Token counts: pieces are counted once for each distinct pre-token and joined to documents.

A first pass counts the pre-tokens of the corpus; the tokenizer then sees every distinct one
once and only its number of pieces is kept, no ids.  The most frequent pre-tokens are broadcast, ``COMMON`` of
them at most and each of at most ``SHORT`` bytes: a histogram of their counts, of a few hundred rows at any size, gives
the count from which they are.  A second pass sums their pieces within each document.  The other
pre-tokens of a document leave with their frequencies, are joined to the table of pieces and summed by
document.  Of those a short one is rare by the same histogram; a longer one, which may be as frequent as any, goes
by its SHA-256 digest and is dealt over ``SALT`` keys.  So no frequent pre-token is ever a single join key.

A pre-token here is what the tokenizer itself would split off: the tokenizer's split never
crosses white space, and inside text of ASCII and Latin-1 letters its rule (contractions, runs of
letters, single digits, runs of others; in lower case) is applied directly.  Other white-space
delimited words, and those that hold a special string, are handed to the tokenizer whole, which
gives their sum exactly.  Both forms rely on a tokenizer of that kind (``word_bpe_49k.json``).

Null text is empty: 0 bytes, 0 tokens.  Repeated rows each get their count; an empty table gives
an empty result.  Other columns of the input play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import checkpointed, merge

COMMON, SHORT, FLUSH, LIMIT = 200_000, 64, 200_000, 2048
#: Steps of the histogram for each doubling of the count, and keys of a long pre-token.
STEPS, SALT = 8, 16
LATIN = "À-ÖØ-öø-ÿ"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\v\f\ra-z0-9ß-öø-ÿ]+"


def splitter(special: tuple[str, ...]):
    """A function from a text to its pre-tokens."""
    piece, odd, space = re.compile(PIECE), re.compile(rf"[^\x00-\x7F{LATIN}]"), re.compile(r"[ \t\n\v\f\r]+")

    def plain(text: str) -> bool:
        return not odd.search(text) and not any(s in text for s in special)

    def split(text: str) -> list[str]:
        if plain(text):
            return piece.findall(text.lower())
        out = []
        for word in space.split(text):
            if word:
                out += piece.findall(word.lower()) if plain(word) else [word]
        return out

    return split


def vocabulary(special: tuple[str, ...]):
    """Over Arrow batches of text: (token, n) of each distinct pre-token, several times for one if they are many."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        split, seen = splitter(special), Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    seen.update(split(text))
                    if len(seen) > FLUSH:
                        yield rows()
        yield rows()

    return run


def counter(tokenizer_json):
    """Over Arrow batches of (token, n): the same with the number of pieces."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            pieces = []
            for i in range(0, len(tokens), 1000):
                pieces += [len(e.ids) for e in tokenizer.encode_batch_fast(tokens[i : i + 1000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["token", "n", "pieces"])

    return run


def step_of(n: Column) -> Column:
    """The histogram's step of a count."""
    return F.floor(F.log2(n.cast("double")) * STEPS).cast("int")


def most_frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of at most SHORT bytes: whole steps of the histogram, of ``most`` rows together at most."""
    short = pieces.filter(F.octet_length("token") <= SHORT)
    least, total = None, 0
    for step, n in sorted(map(tuple, short.groupBy(step_of(F.col("n"))).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return {}
    top = short.filter(step_of(F.col("n")) >= least).select("token", "pieces")
    return dict(zip(*[c.to_pylist() for c in top.toArrow().columns]))


def summer(special: tuple[str, ...], common):
    """Over Arrow batches whose last column is text: in its place, pieces of the common pre-tokens, and the rest's keys with their frequencies."""

    def run(batches):
        import hashlib
        from collections import Counter

        import pyarrow as pa

        split, known = splitter(special), common.value
        for batch in batches:
            sums, tokens, counts = [], [], []
            for text in batch.column(batch.num_columns - 1):
                total, rare = 0, Counter()
                for token, n in Counter(split(text.as_py() or "")).items():
                    if token in known:
                        total += n * known[token]
                    elif len(raw := token.encode("utf-8", "surrogatepass")) > SHORT:
                        rare[" " + hashlib.sha256(raw).hexdigest()] = n  # no pre-token holds a space
                    else:
                        rare[token] = n
                sums.append(total)
                tokens.append(list(rare))
                counts.append(list(rare.values()))
            own = [pa.array(sums, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "known", "tokens", "counts"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), common: int = COMMON) -> DataFrame:
    """``keep``, n_bytes and n_tokens of every row; ``tokenizer``: path of the tokenizer's JSON file on the driver."""
    import json

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    special = tuple(t["content"] for t in json.loads(source)["added_tokens"])
    words = docs.select(docs[text].alias("t")).mapInArrow(vocabulary(special), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = checkpointed(words.mapInArrow(counter(spark.sparkContext.broadcast(source)), "token string, n long, pieces long"))
    known = spark.sparkContext.broadcast(most_frequent(pieces, common))
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), docs[text].alias("_text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in [*names, "n_bytes"])
    summed = rows.mapInArrow(summer(special, known), f"{kinds}, known long, tokens array<string>, counts array<long>")
    summed = checkpointed(summed.withColumn("_row", F.monotonically_increasing_id()))
    salt = lambda key, of: F.when(key.startswith(" "), of).otherwise(F.lit(0))
    rare = summed.select("_row", F.explode(F.arrays_zip("tokens", "counts")).alias("r")).select("_row", F.col("r.tokens").alias("key"), F.col("r.counts").alias("freq"))
    rare = rare.withColumn("salt", salt(F.col("key"), F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int")))
    key = F.when(F.octet_length("token") > SHORT, F.concat(F.lit(" "), F.sha2(F.col("token").cast("binary"), 256))).otherwise(F.col("token"))
    of = pieces.select(key.alias("key"), "pieces")
    of = of.select("key", "pieces", F.explode(F.sequence(F.lit(0), salt(F.col("key"), F.lit(SALT - 1)))).alias("salt"))
    more = rare.join(merge(of), ["key", "salt"]).groupBy("_row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    out = summed.select("_row", *names, "n_bytes", "known").join(more, "_row", "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
