"""Near-duplicate records by meet-in-the-middle ball hashing over sets of words.

A record's fingerprint is the set of its words: the distinct lower-cased runs of letters
and digits. Two sets at distance r (words that only one of them has) meet in the middle:
each side deletes what the other lacks, about half of r, and both arrive at their common
words. So every record emits the ball of what so many deletions leave of its set. The points
of a ball are far too many to be sent one by one, but those that agree in their leading words,
in an order that all records share, can be sent as one. The order begins with words that few
records hold (cold ones, by hash) and ends with the frequent ones, by their number of
records. A point is sent as its first word if that is cold, else as its first two words. A
set of n words has at least t n in common with any set of similarity t, so the first common
word is among the first n - t n + 1 on both sides, and the second among one more: every pair
of similarity t shares a variant, whichever words its edits fall on, and nothing is missed
(but for equal 64-bit hashes of words, which count as one word).

Records meet by shuffling on the variants. Within a run of equal variants exact bounds drop
pairs that can't be similar: a bitmap of the words, their number, and how many
words come before the variant, all of which the other side lacks if this is where the two
meet. So in every possible pair one side is near: it has lost at most (1-t)/(1+t) of its
words. Runs of more than RUN records, and variants whose both words are common, are joined
in Spark, the near sides with all, under the same bounds; nothing is capped. What is left
is deduplicated and verified against the exact words.

Defined results: copies of words fall in one class, whose members need no comparison;
records below the least number of words match nothing; null texts count as empty; a null id
is no record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.groups import connected
from tessera.runtime import Scratch

#: A word is frequent if more than RUN records and more than one in SHARE hold it: at most SHARE times the mean record size are.
RUN, SHARE = 2048, 4096
#: A word is common if more than one record in COMMON holds it.
COMMON = 32
SALTS = 256
BLOCK = 500_000
#: Keys of candidates are sent to all executors while they take no more bytes than this; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20
_MAP2, _TEN = 44, 1023
_ONE = np.uint64(1)


def words(*cols: str):
    """The distinct hashed words of the columns, sorted."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    runs = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x))))


def _constants(n: int, salt: int) -> np.ndarray:
    """Odd 64-bit numbers by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1000)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) | _ONE


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows."""
    off = col.offsets.to_numpy()
    return col.values.to_numpy()[off[0] : off[-1]].view(np.uint64), off - off[0]


class Frequent:
    """The frequent words in order (the rarest first) with the place from which on they are common."""

    def __init__(self, words: np.ndarray, common_from: int):
        self.by, self.common_from = np.argsort(words), common_from
        self.sorted = words[self.by]

    def level(self, flat: np.ndarray) -> np.ndarray:
        """0 for cold words, else 1 + the place in the order."""
        if not len(self.sorted):
            return np.zeros(len(flat), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, flat), len(self.sorted) - 1)
        return np.where(self.sorted[at] == flat, self.by[at] + 1, 0)


def bitmaps(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per record, 64 and 44 bits that its words set; above the latter its number of words, at most 1,023."""
    n = np.diff(off)
    bit = (flat >> np.uint64(7)) % np.uint64(64 + _MAP2)
    maps = []
    for lo, size in ((0, 64), (64, _MAP2)):
        mine = (bit >= lo) & (bit < lo + size)
        x = np.where(mine, _ONE << np.where(mine, bit - np.uint64(lo), 0).astype(np.uint64), np.uint64(0))
        out = np.zeros(len(n), np.uint64)
        if len(flat):
            out[n > 0] = np.bitwise_or.reduceat(x, off[:-1][n > 0])
        maps.append(out)
    return maps[0], maps[1] | (np.minimum(n, _TEN).astype(np.uint64) << np.uint64(_MAP2))


def _parts(b2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map, the number of words and the number of lost words that a long holds."""
    return b2 & np.uint64((1 << _MAP2) - 1), ((b2 >> np.uint64(_MAP2)) & np.uint64(_TEN)).astype(np.int64), (b2 >> np.uint64(_MAP2 + 10)).astype(np.int64)


def possible(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], t: float) -> np.ndarray:
    """False only where the bitmaps, or the words that a side lost for certain, prove that the similarity is below t."""
    (a2, na, la), (b2, nb, lb) = _parts(a[1]), _parts(b[1])
    both = np.bitwise_count(a[0] & b[0]).astype(np.int64) + np.bitwise_count(a2 & b2)
    only_a = np.bitwise_count(a[0]).astype(np.int64) + np.bitwise_count(a2) - both
    only_b = np.bitwise_count(b[0]).astype(np.int64) + np.bitwise_count(b2) - both
    most = np.minimum(na - np.maximum(only_a, la), nb - np.maximum(only_b, lb))
    return (na >= _TEN) | (nb >= _TEN) | (most >= t * (na + nb - most) - 1e-9)


def _leads(m: int):
    """The pairs i < j of m places, in blocks of about BLOCK."""
    a = 0
    while a < m - 1:
        b, size = a, 0
        while b < m - 1 and (b == a or size + m - 1 - b <= BLOCK):
            size += m - 1 - b
            b += 1
        n = m - 1 - np.arange(a, b)
        i = np.repeat(np.arange(a, b), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        a = b


def variants(flat: np.ndarray, off: np.ndarray, frequent: Frequent, salt: np.ndarray, t: float):
    """(keys, rows, lost, common) in blocks: the leading words of the points that deletions leave of the records,
    how many words the other side lacks if the two meet there, and whether both leading words are common."""
    n = np.diff(off)
    of = np.repeat(np.arange(len(n)), n)
    level = frequent.level(flat)
    order = np.lexsort((flat, level, of))
    ordered, level = flat[order], level[order]
    place = np.arange(len(flat)) - off[:-1][of]
    least = np.maximum(1, np.ceil(t * n - 1e-9).astype(np.int64))
    seed = _constants(2, 3)
    with np.errstate(over="ignore"):
        first = _mixed(ordered * seed[0] + salt[of])
        second = _mixed(ordered * seed[1])
    alone = (place <= (n - least)[of]) & ((level == 0) | (least[of] < 2))
    yield first[alone], of[alone], place[alone], np.zeros(int(alone.sum()), bool)
    cold = np.bincount(of, weights=level == 0, minlength=len(n)).astype(np.int64)
    reach = np.minimum(n, n - least + 2)
    m = reach - cold  # frequent words that may lead a point
    for size in np.unique(m[m > 1]):
        every = np.flatnonzero(m == size)
        for i, j in _leads(int(size)):
            step = max(1, BLOCK // len(i))
            for who in (every[k : k + step] for k in range(0, len(every), step)):
                at = (off[who] + cold[who])[:, None]
                x, y = at + i[None, :], at + j[None, :]
                with np.errstate(over="ignore"):
                    key = _mixed(first[x] + second[y])
                yield key.reshape(-1), np.repeat(who, len(i)), (place[y] - 1).reshape(-1), (level[x] > frequent.common_from).reshape(-1)


def _counted(batches):
    held: dict[int, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        if b.num_rows:
            flat, _ = _flat(b.column(0))
            for w, n in zip(*(x.tolist() for x in np.unique(flat.view(np.int64), return_counts=True))):
                held[w] = held.get(w, 0) + n
        if len(held) > 500_000:
            yield out()
            held.clear()
    if held:
        yield out()


def frequent_words(records: DataFrame, n: int, run: int = RUN) -> Frequent:
    """The words that more than ``run`` records and more than one record in SHARE hold."""
    most = max(run, n // SHARE)
    got = records.select("words").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > most).toPandas()
    got = got.sort_values(["n", "word"])
    return Frequent(got["word"].to_numpy(np.int64).view(np.uint64), int((got["n"] * COMMON <= n).sum()))


def _balls(frequent: Frequent, t: float):
    def run(batches):
        seen: set[tuple] = set()
        turn = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            new = [i for i, x in enumerate(h) if x not in seen and not seen.add(x)]  # copies in a task emit once
            if len(seen) > 500_000:
                seen.clear()
            if not new:
                continue
            b = b.take(pa.array(new))
            flat, off = _flat(b.column(3))
            rid = b.column(1).to_numpy()
            b1, b2 = bitmaps(flat, off)
            salt = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for v, rows, lost, common in variants(flat, off, frequent, salt, t):
                if not len(v):
                    continue
                turn += 1
                spread = np.where(common, (np.arange(len(v)) + turn) % SALTS, -1).astype(np.int32)
                two = b2[rows] | (np.minimum(lost, _TEN).astype(np.uint64) << np.uint64(_MAP2 + 10))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(rid[rows]), pa.array(b1[rows].view(np.int64)), pa.array(two.view(np.int64)), pa.array(spread)], names=["variant", "rid", "b1", "b2", "salt"])

    return run


_MET = "a long, b long, variant long, b1 long, b2 long"


def _tile(r: np.ndarray, b1: np.ndarray, b2: np.ndarray, t: float, height: int = 128):
    """The possible pairs of one run, by tiles of rows against the rest."""
    low, n, lost = _parts(b2)
    share = t / (1 + t)
    near = (lost <= (1 - t) / (1 + t) * n + 1e-9) | (n >= _TEN)
    by = np.argsort(~near, kind="stable")  # pairs need a near side
    r, b1, low, n, lost = r[by], b1[by], low[by], n[by], lost[by]
    need = np.where(n >= _TEN, -1000.0, share * n).astype(np.float32)
    room = (n - np.bitwise_count(b1) - np.bitwise_count(low)).astype(np.float32)
    held = (n - lost).astype(np.float32)
    for k in range(0, int(near.sum()), height):
        e = min(k + height, int(near.sum()))
        c = np.bitwise_count(b1[k:e, None] & b1[None, k:]) + np.bitwise_count(low[k:e, None] & low[None, k:])
        want = need[k:e, None] + (need[None, k:] - 1e-4)
        x, y = np.nonzero(c >= want - np.minimum(room[k:e, None], room[None, k:]))
        x, y = x + k, y + k
        keep = (x < y) & (np.minimum(held[x], held[y]) >= need[x] + need[y] - 1e-4)
        yield r[x[keep]], r[y[keep]]


def _meet(t: float, run: int = RUN):
    """Pairs of the runs of equal variants in sorted rows; longer runs, and salted rows, come out as rows for a join."""

    def out(a, b, v, r, b1, b2):
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        z = np.zeros(len(a), np.int64)
        cols = [np.concatenate([a, r]), np.concatenate([b, np.zeros(len(r), np.int64)]), np.concatenate([z, v]), np.concatenate([z, b1]), np.concatenate([z, b2])]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in cols], names=["a", "b", "variant", "b1", "b2"])

    def pairs(v, r, b1, b2):
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])  # copies from several tasks
        v, r, b1, b2 = v[new], r[new], b1[new].view(np.uint64), b2[new].view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.concatenate([start, [len(v)]]))
        a, b, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for size in range(2, 17):
            s = start[n == size]
            for d in range(1, size if len(s) else 1):
                x = (s[:, None] + np.arange(size - d)[None, :]).reshape(-1)
                ok = possible((b1[x], b2[x]), (b1[x + d], b2[x + d]), t)
                a.append(r[x[ok]])
                b.append(r[x[ok] + d])
        for s, size in zip(start[n > 16].tolist(), n[n > 16].tolist()):
            if size > run:
                hot.append(np.arange(s, s + size))
                continue
            for x, y in _tile(r[s : s + size], b1[s : s + size], b2[s : s + size], t):
                a.append(x)
                b.append(y)
        h = np.concatenate(hot) if hot else np.zeros(0, np.int64)
        return out(np.concatenate(a), np.concatenate(b), v[h], r[h], b1[h].view(np.int64), b2[h].view(np.int64))

    def go(batches):
        none = np.zeros(0, np.int64)
        held = [none, none, none, none]
        batches = iter(batches)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            salted = batch.column(4).to_numpy() >= 0
            if salted.any():
                yield out(none, none, *(c[salted] for c in cols))
                cols = [c[~salted] for c in cols]
            held = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            v = held[0]
            if len(v) < 200_000:
                continue
            cut = int(np.searchsorted(v, v[-1]))  # the last run may go on
            if cut:
                yield pairs(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
            if len(held[0]) > 100_000:
                # a hot run comes out as rows
                v, r, b1, b2 = held
                yield out(none, none, v, r, b1, b2)
                last = v[-1]
                held = [none, none, none, none]
                yield from drain(batches, last, held)
        if len(held[0]):
            yield pairs(*held)

    def drain(batches, last, held):
        """The rest of a hot run as rows, up to the batch in which it ends."""
        none = np.zeros(0, np.int64)
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            salted = batch.column(4).to_numpy() >= 0
            mine = (cols[0] == last) | salted
            if mine.any():
                yield out(none, none, *(c[mine] for c in cols))
            if not mine.all():
                held[:] = [c[~mine] for c in cols]
                return

    return go


def _near_and_all(hot: DataFrame, t: float) -> DataFrame:
    """The possible pairs of the hot runs: near sides with all, under the bounds of ``possible``."""
    low = (1 << _MAP2) - 1

    def side(s: str) -> DataFrame:
        n = F.shiftrightunsigned("b2", _MAP2).bitwiseAND(F.lit(_TEN))
        lost = F.shiftrightunsigned("b2", _MAP2 + 10)
        bits = F.bit_count("b1") + F.bit_count(F.col("b2").bitwiseAND(F.lit(low)))
        return hot.select("variant", F.col("a").alias(s), F.col("b1").alias(s + "1"), F.col("b2").bitwiseAND(F.lit(low)).alias(s + "2"), n.alias(s + "n"), lost.alias(s + "l"), (n - bits).alias(s + "room"))

    x, y = side("x"), side("y")
    x = x.where((F.col("xl") <= (1 - t) / (1 + t) * F.col("xn") + 1e-9) | (F.col("xn") >= _TEN))
    both: Column = F.bit_count(F.col("x1").bitwiseAND(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseAND(F.col("y2")))
    need = t / (1 + t) * (F.col("xn") + F.col("yn")) - 1e-6
    fits = (both + F.least("xroom", "yroom") >= need) & (F.least(F.col("xn") - F.col("xl"), F.col("yn") - F.col("yl")) >= need)
    fits = fits | (F.col("xn") >= _TEN) | (F.col("yn") >= _TEN)
    return x.join(y, (x["variant"] == y["variant"]) & (F.col("x") != F.col("y")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidates(records: DataFrame, t: float, run: int = RUN) -> DataFrame:
    """Distinct (a, b), a < b: hashes of records that may be similar."""
    frequent = frequent_words(records, records.count(), run)
    v = records.select("table_code", "h1", "h2", "words").mapInArrow(_balls(frequent, t), "variant long, rid long, b1 long, b2 long, salt int")
    met = v.repartition("variant", "salt").sortWithinPartitions("variant", "rid").mapInArrow(_meet(t, run), _MET)
    met = Scratch(records.sparkSession).save(met)
    hot = met.where("variant <> 0").select("a", "variant", "b1", "b2").distinct()
    return met.where("variant = 0").select("a", "b").unionByName(_near_and_all(hot, t)).distinct()


def records_of(df: DataFrame, code: int, id_col: str, cols: list[str], least: int) -> DataFrame:
    w = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), words(*cols).alias("words"))
    return w.where(F.size("words") >= least).select(F.lit(code).cast("long").alias("table_code"), "id", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), "words")


def similar(tables: dict[str, tuple[DataFrame, str, list[str]]], t: float = 0.7, least: int = 20, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """For tables {name: (rows, id column, text columns)}: the verified pairs of classes
    (rec_table, a_h1, a_h2, b_h1, b_h2), and the members (rec_table, id, h1, h2) of the classes."""
    spark = next(iter(tables.values()))[0].sparkSession
    keep = Scratch(spark)
    names = list(tables)
    all_of = None
    for code, name in enumerate(names):
        df, id_col, cols = tables[name]
        x = records_of(df, code, id_col, cols, least)
        all_of = x if all_of is None else all_of.unionByName(x)
    rec = keep.save(all_of)
    cand = keep.save(candidates(rec, t, run))
    wanted = cand.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    small = 2 * 16 * cand.count() <= BROADCAST_BYTES
    sets = rec.select("table_code", "h1", "h2", "words").join(F.broadcast(wanted) if small else wanted, "h1", "left_semi").dropDuplicates(["table_code", "h1", "h2"])

    def side(s: str) -> DataFrame:
        return sets.select(F.col("h1").alias(s), F.col("table_code").alias(s + "_t"), F.col("h2").alias(s + "_h2"), F.col("words").alias(s + "_w"))

    both = cand.join(side("a"), "a").join(side("b"), "b").where("a_t = b_t")
    inter = F.size(F.array_intersect("a_w", "b_w"))
    ok = both.withColumn("i", inter).where(F.col("i") >= t * (F.size("a_w") + F.size("b_w") - F.col("i")) - 1e-9)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("a_t") + 1).cast("int"))
    pairs = keep.save(ok.select(name.alias("rec_table"), F.col("a").alias("a_h1"), "a_h2", F.col("b").alias("b_h1"), "b_h2"))
    own = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("table_code") + 1).cast("int"))
    return pairs, rec.select(own.alias("rec_table"), "id", "h1", "h2")


def pairs_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_table, a, b), a < b: the pairs of records, those within a class and those of similar classes."""
    m = members.distinct()
    x = m.select("rec_table", F.col("id").alias("x"), F.col("h1").alias("a_h1"), F.col("h2").alias("a_h2"))
    y = m.select("rec_table", F.col("id").alias("y"), F.col("h1").alias("b_h1"), F.col("h2").alias("b_h2"))
    across = pairs.join(x, ["rec_table", "a_h1", "a_h2"]).join(y, ["rec_table", "b_h1", "b_h2"]).select("rec_table", "x", "y")
    within = x.join(y.withColumnsRenamed({"b_h1": "a_h1", "b_h2": "a_h2"}), ["rec_table", "a_h1", "a_h2"]).select("rec_table", "x", "y").where("x < y")
    return across.unionByName(within).where("x <> y").select("rec_table", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_table, id, group_id) of the records that have a near-duplicate, directly or through others. No pairs of copies are formed."""
    rep = members.groupBy("rec_table", "h1", "h2").agg(F.min("id").alias("rep"))
    ra = rep.select("rec_table", F.col("h1").alias("a_h1"), F.col("h2").alias("a_h2"), F.col("rep").alias("ra"))
    rb = rep.select("rec_table", F.col("h1").alias("b_h1"), F.col("h2").alias("b_h2"), F.col("rep").alias("rb"))
    tag = F.concat("rec_table", F.lit("\t"))
    links = pairs.join(ra, ["rec_table", "a_h1", "a_h2"]).join(rb, ["rec_table", "b_h1", "b_h2"]).select(F.concat(tag, "ra").alias("a"), F.concat(tag, "rb").alias("b"))
    copies = members.join(rep, ["rec_table", "h1", "h2"]).where("id <> rep").select(F.concat(tag, "rep").alias("a"), F.concat(tag, "id").alias("b")).distinct()
    g = connected(links.unionByName(copies))
    part = lambda c, i: F.element_at(F.split(c, "\t", 2), i)
    return g.select(part("id", 1).alias("rec_table"), part("id", 2).alias("id"), part("group_id", 2).alias("group_id"))
