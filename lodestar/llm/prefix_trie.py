"""The trie of conversations' prefixes, by polynomial fingerprints that are verified turn by turn.

Turns are dealt out by ranges of conversation and place, so a conversation may span many tasks. Each task
scans its turns with numpy: S(i) = sum of hash(turn j) * base**j over j <= i, modulo 2**64; what a
conversation brings from the task before is added afterwards. Prefixes that start with turns of another
conversation have the fingerprint of that start plus a shifted difference of two S. Prefixes of the same depth
and fingerprint are candidates for one node: each member's last turn is compared, character by character,
with that of the group's representative, its smallest conversation. Equal last turns and fingerprints mean
equal fingerprints one turn earlier, so when all groups agree, all prefixes agree turn by turn. If a group does
not, it is split by one more fingerprint of other symbols, until all agree.

Sums over subtrees need no walk: below a node lie the tails that its members own. A conversation owns the nodes
whose smallest member it is, which are the last ones of its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import running
from .common import _BASE, _INVERSE, POWERS, cut, mix, partitions, prefix_hash, release, salted_join, span_hash, table, text_buffers
from .oracle import CRC_TABLE, crc32

#: Ids of a node's list that travel as one row.
LIST = 1 << 14
#: Fingerprints after which turns that still do not agree are an error (two would do for ever).
MOST_ROUNDS = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = (1 << 64) - 1


def _symbols(round_: int) -> np.ndarray:
    """The values of the 256 bytes in a round's hashes."""
    return np.arange(256, dtype=np.uint64) if not round_ else np.random.default_rng(round_).integers(0, 1 << 63, 256, np.uint64)


def turn_hashes(role: pa.Array, text: pa.Array, round_: int, bits: int) -> np.ndarray:
    """A hash of (role, text) of each row; other rounds give independent ones; bits: how many of them count."""
    parts, values = [], _symbols(round_)
    for column in (role, text):
        out = [np.zeros(0, np.uint64)]
        for _, data, offsets in text_buffers(column):
            out.append(span_hash(prefix_hash(values[data]), offsets[:-1], offsets[1:]))
        parts.append(np.concatenate(out))
    return mix(parts[0] * np.uint64(0xD1342543DE82EF95) + parts[1]) & np.uint64((1 << bits) - 1)


def scan(ids: np.ndarray, hashes: list[np.ndarray], carry: tuple[int, int, list[int]] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places (from 1) and S of each row in its run of equal ids; carry: id, length and S of a run before the first row."""
    n = len(ids)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    local = np.arange(n) - first[run]
    up, _ = POWERS.get(n + 1)
    place, sums = local + 1, []
    goes_on = carry is not None and carry[0] == ids[0]
    upto = int(first[1]) if len(first) > 1 else n
    if goes_on:
        place[:upto] += carry[1]
    for r, t in enumerate(hashes):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * up[local + 1], dtype=np.uint64)])
        s = total[1:] - total[first[run]]
        if goes_on:
            s[:upto] = s[:upto] * np.uint64(pow(_BASE, carry[1], 1 << 64)) + np.uint64(carry[2][r])
        sums.append(s)
    return place, sums


def _ranged(turns: DataFrame) -> DataFrame:
    """(rid, part, conv_id, role, text, n_bytes): turns in order, a range of it in each partition."""
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = rows.where("conv_id is not null").repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.select(F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"), "conv_id", "role", "text", F.octet_length("text").cast("bigint").alias("n_bytes")))


def _scanned(ranged: DataFrame, rounds: int, bits: int) -> DataFrame:
    """(rid, conv_id, n_bytes, place, s0, s1, ...): every turn's place in its conversation and fingerprints up to it."""
    names = [f"s{r}" for r in range(rounds)]
    schema = "rid bigint, part int, conv_id bigint, n_bytes bigint, place bigint, " + ", ".join(f"{s} bigint" for s in names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(2).to_numpy()
            place, sums = scan(ids, [turn_hashes(batch.column(3), batch.column(4), r, bits) for r in range(rounds)], carry)
            carry = int(ids[-1]), int(place[-1]), [int(s[-1]) for s in sums]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(5), pa.array(place, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums)], names=["rid", "part", "conv_id", "n_bytes", "place", *names])
        release()

    local = cut(ranged.mapInArrow(within, schema))
    # what a partition's last conversation hands on: two rows a partition, however long the conversations
    runs = local.groupBy("part", "conv_id").agg(F.max(F.struct("place", *names)).alias("last"))
    ends = runs.groupBy("part").agg(*(by(F.struct("conv_id", "last.*"), "conv_id").alias(n) for by, n in ((F.min_by, "head"), (F.max_by, "tail"))))
    brought, carry = {}, None
    for row in ends.orderBy("part").collect():
        head, tail = row["head"], row["tail"]
        if carry is not None and carry[0] == head["conv_id"]:
            brought[row["part"]] = carry
        else:
            carry = None
        if carry is not None and tail["conv_id"] == head["conv_id"]:
            power = pow(_BASE, carry[1], 1 << 64)
            carry = carry[0], carry[1] + tail["place"], [(s + power * (tail[n] & _WORD)) & _WORD for s, n in zip(carry[2], names, strict=True)]
        else:
            carry = tail["conv_id"], tail["place"], [tail[n] & _WORD for n in names]
    if not brought:
        return local.drop("part")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = brought.get(TaskContext.get().partitionId())
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if before is not None:
                own = batch.column(2).to_numpy() == before[0]
                columns["place"] = pa.array(batch.column(4).to_numpy() + own * before[1])
                power = np.uint64(pow(_BASE, before[1], 1 << 64))
                for name, s in zip(names, before[2], strict=True):
                    now = columns[name].to_numpy().view(np.uint64)
                    columns[name] = pa.array(np.where(own, now * power + np.uint64(s), now).view(np.int64))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return cut(local.mapInArrow(across, schema).drop("part"))


def _rebuilt(own: DataFrame, rounds: int, bits: int, group: int, depths: int) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, length) and their prefixes (conv_id, depth, f0, ..., n_bytes, rid, length).

    Conversation c starts with the first h = crc32(c) % depths turns of c - c % group, as far as there are that
    many, and goes on with its own turns after its first h. A base has at most group conversations.
    """
    s, f = [f"s{r}" for r in range(rounds)], [f"f{r}" for r in range(rounds)]
    convs = cut(own.groupBy("conv_id").agg(F.max("place").alias("n")))
    early = own.where(F.col("place") < depths)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % depths).cast("bigint")
    v = convs.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    v = v.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    for at, who, name in (("k", "base", "start"), ("h", "conv_id", "skip")):
        v = v.join(early.select(F.col("conv_id").alias(who), F.col("place").alias(at), *(F.col(x).alias(f"{name}_{x}") for x in s)), [who, at], "left")
    v = cut(v.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    mask = np.uint64((1 << bits) - 1)

    heads = early.select(F.col("conv_id").alias("base"), "place", *s, "n_bytes", "rid")
    started = v.select("conv_id", "base", "k", "length").join(heads, "base").where(F.col("place") <= F.col("k"))
    kept = [F.col(a).bitwiseAND(F.lit(int(mask)) if bits < 64 else F.lit(-1)).alias(b) for a, b in zip(s, f, strict=True)]
    started = started.select("conv_id", F.col("place").alias("depth"), *kept, "n_bytes", "rid", "length")

    starts = v.select("conv_id", "h", "k", "length", *(f"{n}_{x}" for n in ("start", "skip") for x in s))
    rest = salted_join(own, starts, ["conv_id"], counts=convs.select("conv_id", F.col("n").alias("_n"))).where(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", (F.col("k") + F.col("place") - F.col("h")).alias("depth"), "n_bytes", "rid", "length", (F.col("h") - F.col("k")).alias("back"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (*s, *(f"{n}_{x}" for n in ("start", "skip") for x in s))))
    down = np.asarray([pow(_INVERSE, j, 1 << 64) for j in range(depths)], np.uint64)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            back, made = down[get("back").to_numpy()], []
            for x in s:
                now, start, skip = (get(n).to_numpy().view(np.uint64) for n in (x, f"start_{x}", f"skip_{x}"))
                made.append(pa.array(((start + back * (now - skip)) & mask).view(np.int64)))
            yield pa.record_batch([get("conv_id"), get("depth"), *made, get("n_bytes"), get("rid"), get("length")], names=["conv_id", "depth", *f, "n_bytes", "rid", "length"])

    rest = rest.mapInArrow(shifted, "conv_id bigint, depth bigint, " + "".join(f"{x} bigint, " for x in f) + "n_bytes bigint, rid bigint, length bigint")
    return v.select("conv_id", "length"), cut(started.unionByName(rest))


def _agree(members: DataFrame, ranged: DataFrame) -> bool:
    """Whether the last turn of every member is, character by character, that of its group's representative."""
    pairs = cut(members.where("rid <> rep").select("rid", "rep").distinct())
    if pairs.isEmpty():
        return True
    texts = ranged.select("rid", "role", "text")
    own = texts.join(pairs, "rid")
    reps = texts.join(pairs.select(F.col("rep").alias("rid")).distinct(), "rid").select(F.col("rid").alias("rep"), F.col("role").alias("rep_role"), F.col("text").alias("rep_text"))
    met = salted_join(own, reps, ["rep"], counts=pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")), rows=pairs.count())
    return met.where((F.col("role") != F.col("rep_role")) | (F.col("text") != F.col("rep_text"))).isEmpty()


def _ends(paths: DataFrame, n: int) -> DataFrame:
    """(conv_id, depth, ends_sha256): the digest of the sorted ids of those that end in a node.

    Ids meet in ranges first; a node's digest then reads lists of LIST ids in order, one at a time.
    """
    order = ["node", "depth", "conv_id"]
    dealt = paths.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, ids = (batch.column(k).to_numpy() for k in range(3))
            if not len(ids):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])).tolist()
            cuts = sorted({*cuts, *(k for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True) for k in range(a, b, LIST))})
            told = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.record_batch([pa.array(node[cuts]), pa.array(depth[cuts]), pa.array(ids[cuts]), pa.array(told, pa.string())], names=["node", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, ([], [], [])

        def close() -> None:
            if now is not None:
                for column, value in zip(out, (*now, state.hexdigest()), strict=True):
                    column.append(value)

        for batch in batches:
            for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (node, depth) != now:
                    close()
                    now, state = (node, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])
            out = ([], [], [])
        close()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])

    chunks = dealt.select(*order).mapInArrow(lists, "node bigint, depth bigint, first bigint, ids string")
    return chunks.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "node bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 1, depths: int = 1, bits: int = 64) -> DataFrame:
    """The nodes of the trie of all conversations in turns (conv_id, turn, role, text).

    A node is a distinct sequence of first turns. (conv_id, depth) names it: its smallest member and its number of
    turns. parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes at or below it),
    saved_tokens (bytes of last turns that later members repeat, summed at and below it), ends_sha256, and rid, the
    place of its last turn in the order of all turns.

    With group and depths over 1, conversation c is rebuilt first: it starts with the first h = crc32(c) % depths turns of
    conversation c - c % group (all if fewer, none if absent) and goes on with its own turns after its first h. The
    defaults leave conversations as they are. bits under 64 weaken the fingerprints, for tests.

    Turns stand in order of turn (null first), then role, then text; rows that agree in all stay as repeated turns. A null
    role or text counts as empty. Rows without a conv_id are left out, and so are other columns. A conversation
    without turns left is a member of the root alone. No conversations give no nodes.
    """
    ranged = _ranged(turns)
    for rounds in range(1, MOST_ROUNDS + 1):
        own = _scanned(ranged, rounds, bits)
        convs, prefixes = _rebuilt(own, rounds, bits, group, depths)
        key = ["depth", *(f"f{r}" for r in range(rounds))]
        groups = cut(prefixes.groupBy(*key).agg(F.min(F.struct("conv_id", "rid", "n_bytes")).alias("least"), F.count(F.lit(1)).alias("_n"), F.max("length").alias("deepest")))
        named = groups.select(*key, F.col("least.conv_id").alias("node"), F.col("least.rid").alias("rep"))
        members = cut(salted_join(prefixes, named, key, counts=groups.select(*key, "_n")).select("conv_id", "depth", "node", "rid", "rep", "length"))
        if _agree(members, ranged):
            return _nodes(convs, members, groups)
    raise RuntimeError("turns that differ have equal fingerprints in every round")


def _nodes(convs: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    spark = convs.sparkSession
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    nodes = groups.select(F.col("least.conv_id").alias("node"), "depth", F.col("_n").alias("n_convs"), F.col("least.rid").alias("rid"), ((F.col("_n") - 1) * F.col("least.n_bytes")).alias("cost"), (F.col("deepest") == F.col("depth")).cast("bigint").alias("leaf"))
    # of each conversation: where the nodes that it owns begin, below which node, and where its path ends
    not_own = F.when(F.col("node") < F.col("conv_id"), F.struct("depth", "node"))
    paths = members.groupBy("conv_id").agg(F.max(not_own).alias("above"), F.max(F.struct("depth", "node")).alias("end"))
    paths = convs.join(paths, "conv_id", "left").select("conv_id", F.coalesce("above.depth", F.lit(0)).alias("from_depth"), F.coalesce("above.node", F.lit(top["conv_id"])).cast("bigint").alias("above"), F.coalesce("end.node", F.lit(top["conv_id"])).cast("bigint").alias("node"), F.col("length").alias("depth"))
    owned = nodes.groupBy("node").agg(F.sum("cost").alias("own_cost"), F.max("leaf").alias("own_leaf"), F.count(F.lit(1)).alias("_n"))
    paths = cut(paths.join(owned.withColumnRenamed("node", "conv_id"), "conv_id", "left"))

    tails = paths.select("conv_id", "own_cost", "own_leaf").where("own_cost is not null")
    passing = members.where("node <> conv_id")
    below = salted_join(passing, tails, ["conv_id"]).groupBy("node", "depth").agg(F.sum("own_cost").alias("cost_below"), F.sum("own_leaf").alias("leaves_below"))
    tail = running(nodes.select("node", "depth", "cost"), ["node"], [F.desc("depth")], {"cost_here": F.col("cost")}).select("node", "depth", "cost_here")
    hung = salted_join(nodes, paths.select(F.col("conv_id").alias("node"), "from_depth", "above", "own_leaf"), ["node"], counts=owned.select("node", "_n"))
    hung = cut(hung.withColumn("parent", F.when(F.col("depth") - 1 > F.col("from_depth"), F.col("node")).otherwise(F.col("above"))))
    children = hung.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(paths.select("node", "depth", "conv_id"), partitions(spark))
    at = ["node", "depth"]
    whole = hung.join(children, at, "left").join(below, at, "left").join(tail, at, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    whole = whole.select("node", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", zero("n_children").alias("n_children"), (zero("leaves_below") + zero("own_leaf")).alias("n_leaves"), (zero("cost_below") + zero("cost_here")).alias("saved_tokens"), "rid")
    if top["n"]:
        sums = nodes.agg(F.sum(F.when(F.col("depth") == 1, 1)).alias("children"), F.sum("leaf").alias("leaves"), F.sum("cost").alias("cost")).first()
        root = (top["conv_id"], 0, None, top["n"], sums["children"] or 0, sums["leaves"] or 1, sums["cost"] or 0, None)
        whole = whole.unionByName(spark.createDataFrame([root], "node bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, rid bigint"))
    return whole.join(ends, at, "left").select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), group=5, depths=9).drop("rid")


_ROLE, _TEXT = "coalesce(role, '')", "coalesce(text, '')"
#: Prefixes by the joined digests of their turns; a node's subtree are the nodes whose key begins with its own.
ORACLE = f"""with {CRC_TABLE}, t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, {_ROLE}, {_TEXT}) as i, {_ROLE} as role, {_TEXT} as text from conversations where conv_id is not null),
    n as (select conv_id, count(*) as n from t group by conv_id),
    c as (select conv_id, n, conv_id - conv_id % 5 as base, {crc32("cast(conv_id as varchar)")} % 9 as h from n cross join crc_),
    r as (select c.conv_id, t.i as d, role, text from c join t on t.conv_id = c.base and t.i <= c.h
        union all select c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h, role, text from c left join n b on b.conv_id = c.base join t on t.conv_id = c.conv_id and t.i > c.h),
    l as (select c.conv_id, count(r.d) as len from c left join r on r.conv_id = c.conv_id group by c.conv_id),
    k as (select conv_id, d, octet_length(encode(text)) as bytes, string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by d rows between unbounded preceding and current row) as key from r
        union all select conv_id, 0, 0, '' from l),
    v as (select d, key, min(k.conv_id) as node, count(*) as n_convs, min(bytes) as bytes, max(len) = d as leaf, string_agg(cast(k.conv_id as varchar), ',' order by k.conv_id) filter (where len = d) as ends from k join l on l.conv_id = k.conv_id group by d, key),
    up as (select substr(key, 1, cast(64 * a as int)) as key, count(*) filter (where leaf) as n_leaves, sum((n_convs - 1) * bytes) as saved, count(*) filter (where a = d - 1) as n_children from (select *, unnest(range(0, d + 1)) as a from v) x group by 1)
    select v.node as conv_id, v.d as depth, p.node as parent_conv_id, v.n_convs, up.n_children, up.n_leaves, cast(up.saved as bigint) as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
    from v join up on up.key = v.key left join v p on v.d > 0 and p.d = v.d - 1 and p.key = substr(v.key, 1, cast(64 * (v.d - 1) as int))"""
