"""A trie over conversations: radix partitioning of turn numbers from the first on, until what is left of a bucket fits a task."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import batch_of, looked_up, placed, runs
from .tables import crc32_sql, discard, load, partitions, written

#: Turns that one row of a sequence holds, and that one round can pass.
CHUNK = 512
#: Turns of all sequences of a bucket that one task finishes; larger buckets are split further.
LOCAL = 20_000
#: Conversations whose first turns their neighbours take over, and of those turns fewer than this many.
FAMILY, SHARED = 100, 6
#: Bytes of ids that travel in one row on their way to a digest.
PIECE = 1 << 16
EMPTY = sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long"
_NODES = pa.schema([(x.split()[0], pa.int64()) for x in _NODE.split(", ")])


def turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 0, key and size of each turn, in the order of turn (null first); equal ones go by key."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.char_length(text).cast("long").alias("size"))
    return placed(written(rows, "trie-turns"), ["conv_id"], ["turn", "key"], "trie-order").drop("turn", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and their turns (conv_id, depth from 1, key, size): the family head's first ones, then their own."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((first == F.col("conv_id")) & (F.col("place") < SHARED - 1)).groupBy(F.col("conv_id").alias("head"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "key", "size"))).alias("taken"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED)
    convs = convs.join(heads, F.col("head") == first, "left").withColumn("taken", F.slice(F.coalesce("taken", F.array().cast("array<struct<place:bigint,key:binary,size:bigint>>")), 1, F.col("h").cast("int")))
    convs = written(convs.select("conv_id", "own", "h", "taken", (F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-convs")
    shared = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.key", "t.size")
    names = convs.select("conv_id", "h", F.size("taken").alias("before"), F.col("own").alias("_rows"))
    rest = looked_up(turns, names, ["conv_id"], turns.count()).where("place >= h")
    return convs, shared.unionByName(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("before") + 1).alias("depth"), "key", "size"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (print, conv_id) in this order -> for each print its ids as texts of about PIECE bytes, each with its first id and count."""
    schema = pa.schema([("print", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    key, held, size, out, sent = None, [], 0, [], 0

    def close() -> None:
        nonlocal held, size, sent
        if held:
            out.append((key, held[0], len(held), ",".join(map(str, held))))
            sent += size
        held, size = [], 0

    for batch in batches:
        for mark, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if mark != key or size > PIECE:
                close()
                key = mark
            held.append(conv)
            size += 12
        if sent > PIECE or len(out) > 1000:
            yield batch_of(schema, out)
            out, sent = [], 0
    close()
    yield batch_of(schema, out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (print, first, n, ids) in order -> each print's least id, number and the digest of all ids, fed piece by piece."""
    schema = pa.schema([("print", pa.binary()), ("seq", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    key = first = state = None
    n, out = 0, []
    for batch in batches:
        for mark, begin, count, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if mark != key:
                if state:
                    out.append((key, first, n, state.hexdigest()))
                key, first, n, state = mark, begin, 0, sha256()
            state.update(f",{ids}".encode() if n else ids.encode())
            n += count
        yield batch_of(schema, out)
        out = []
    if state:
        yield batch_of(schema, [(key, first, n, state.hexdigest())])


def distinct_sequences(prints: DataFrame) -> DataFrame:
    """(conv_id, print) -> (print, seq, n, ends): of equal conversations the least id, how many, and the SHA-256 of their ids.

    A digest needs its group in order: groups are dealt into ranges, packed there into pieces, and only pieces meet in one task.
    """
    dealt = prints.select("print", "conv_id").repartitionByRange(partitions(prints.sparkSession), "print", "conv_id").sortWithinPartitions("print", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "print binary, first long, n long, ids string")
    return pieces.repartition("print").sortWithinPartitions("print", "first").mapInArrow(_ends, "print binary, seq long, n long, ends string")


def multikey_quicksort(rows: list[tuple[int, int, list[int], list[int]]], depth: int, parent: int) -> tuple[list[list], tuple[int, int, int]]:
    """Sequences (least id, conversations, digits, sizes) of one bucket -> its nodes below the top, and what the top has below it.

    Three-way partitioning by one digit: those equal to the pivot are a child, which is split by the next digit. Nodes come
    before their children, so one pass backwards sums up subtrees. The stack is explicit: sequences may be longer than Python's.
    """
    out: list[list] = [[parent, depth, None, 0, 0, 0, 0, None, -1, 0]]
    work = [(rows, 0, 0)]  # sequences, place of the digit, node that they are below
    while work:
        some, at, up = work.pop()
        some = [r for r in some if len(r[2]) > at]
        if not some:
            continue
        pivot = some[len(some) // 2][2][at]
        low, like, high = [], [], []
        for r in some:
            d = r[2][at]
            (like if d == pivot else low if d < pivot else high).append(r)
        work += [(x, at, up) for x in (high, low) if x]
        first, n = min(r[0] for r in like), sum(r[1] for r in like)
        while True:  # a chain needs no partitioning
            end = next((r[0] for r in like if len(r[2]) == at + 1), None)
            out.append([first, depth + at + 1, out[up][0], n, 0, 0, (n - 1) * like[0][3][at], end, up, 0])
            up, at = len(out) - 1, at + 1
            if len(like) > 1 or len(like[0][2]) == at:
                break
        work.append((like, at, up))
    for node in reversed(out):
        node[5] = node[5] or 1
        if node[8] >= 0:
            above = out[node[8]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    top = out[0]
    return [x[:8] for x in out[1:]], (top[4], top[5], top[6])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, depth, top, seq, n, chunk, digits, sizes) by bucket, sequence and chunk -> nodes, and one row a bucket for its top."""
    schema = pa.schema([("bucket", pa.string()), *_NODES])
    out = []
    for (bucket, depth, top), rows in runs(batches, 3):
        whole: dict[int, tuple] = {}
        for *_, seq, n, _, digits, sizes in rows:
            if seq in whole:
                whole[seq][2].extend(digits)
                whole[seq][3].extend(sizes)
            else:
                whole[seq] = (seq, n, list(digits), list(sizes))
        nodes, (children, leaves, below) = multikey_quicksort(list(whole.values()), depth, top)
        out.append((bucket, None, None, None, None, children, leaves, below, None))
        out += [(None, *x) for x in nodes]
        if len(out) > 4096:
            yield batch_of(schema, out)
            out = []
    yield batch_of(schema, out)


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    pairs = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.size(pairs)).cast("int")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node (see the contract of op12).

    Input: conv_id, turn, role, text; other columns are ignored. Rows without conv_id belong to no conversation and are left out.
    Turns without a number come first; turns of one number go by the MD5 of role and text, and a turn that is logged twice counts
    twice. A null role or text equals an empty one. An empty table gives no nodes, not even a root.

    Turns are numbered by a dictionary of their 128-bit keys, and equal conversations become one sequence with a count. Buckets
    of sequences are split by the digit after their common prefix, which a round passes at once (up to CHUNK turns); a bucket
    with one sequence needs no task, one of up to LOCAL turns is finished by multikey quicksort, others go on. So no bucket is
    gathered, and rounds follow the depth at which large buckets divide: two conversations with a million turns in common take
    a round for each CHUNK of them. Long conversations are rows of CHUNK turns.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(written(numbered_turns(conversations), "trie-places"))
    turns = written(turns, "trie-rebuilt")
    total = turns.count()
    names = turns.groupBy("key").agg(F.count("*").alias("_rows")).withColumn("digit", F.monotonically_increasing_id())
    turns = written(looked_up(turns, written(names, "trie-dictionary"), ["key"], total).withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK)), "trie-digits")
    # the number of turns and two sums over places and digits tell sequences apart
    marks = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "digit")).alias("p"), F.bit_xor(F.xxhash64("digit", F.lit("turn"), "depth")).alias("q"))
    prints = convs.join(marks, "conv_id", "left").select("conv_id", "n_turns", F.unhex(F.concat_ws("", *[F.lpad(F.hex(F.coalesce(c, F.lit(0))), 16, "0") for c in ("p", "q", "n_turns")])).alias("print"))
    prints = written(prints, "trie-prints")
    seqs = written(distinct_sequences(prints).join(prints.select(F.col("conv_id").alias("seq"), "n_turns"), "seq"), "trie-sequences")
    chunks = turns.join(seqs.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").groupBy(F.col("conv_id").alias("seq"), "chunk")
    chunks = chunks.agg(F.array_sort(F.collect_list(F.struct("depth", "digit", "size"))).alias("t")).select("seq", "chunk", F.col("t.digit").alias("digits"), F.col("t.size").alias("sizes"))
    tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    later = Window.partitionBy("seq").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = written(chunks.withColumn("tokens", tokens).withColumn("after", F.coalesce(F.sum("tokens").over(later), F.lit(0))), "trie-chunks")

    # all sequences begin in the root's bucket; members: bucket, depth, seq, n, n_turns
    members = seqs.select(F.lit("").alias("bucket"), F.lit(0).cast("long").alias("depth"), "seq", "n", "n_turns")
    root = members.groupBy("bucket").agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"))
    buckets = root.select("bucket", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), "conv_id", F.col("conv_id").alias("top"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("size"))
    members, buckets = written(members, "trie-members"), written(buckets, "trie-buckets")
    done: list[DataFrame] = []  # nodes below the tops of buckets that are finished
    rounds: list[tuple[DataFrame, DataFrame]] = []  # buckets of a round with their sums, those of split ones still open
    while buckets.limit(1).count():
        # what is left of each sequence in the chunk where it stands; an ended one has nothing left
        here = members.withColumn("chunk", F.floor(F.col("depth") / CHUNK)).join(chunks, ["seq", "chunk"], "left")
        skip = (F.col("depth") % CHUNK + 1).cast("int")
        cut = lambda c: F.coalesce(F.slice(c, skip, CHUNK), F.array().cast("array<bigint>"))
        here = written(here.withColumns({"digits": cut("digits"), "sizes": cut("sizes")}), "trie-here")
        shape = here.groupBy("bucket").agg(
            F.count("*").alias("_rows"), F.sum(F.col("n_turns") - F.col("depth")).alias("left"), F.min("digits").alias("low"), F.max("digits").alias("high"),
            F.min(F.struct("digits", "n_turns", "seq")).alias("least"), F.first("sizes").alias("sizes"),
        )
        kind = F.when(F.col("_rows") == 1, "alone").when(F.col("left") <= LOCAL, "local").otherwise("split")
        shape = shape.withColumn("kind", kind).withColumn("common", _common(F.col("low"), F.col("high")))
        shape = shape.withColumn("common", F.when(F.col("kind") == "split", F.col("common")).otherwise(0))
        plan = buckets.join(shape.select("bucket", "_rows", "kind", "common", "least", F.slice("sizes", F.lit(1), F.col("common")).alias("way")), "bucket")
        # the one sequence that ends at the top, or after the common prefix, is the least there
        end = F.when(F.col("least.n_turns") == F.col("depth") + F.col("common"), F.col("least.seq"))
        plan = written(plan.withColumn("end_seq", end).drop("least"), "trie-plan")
        names = plan.select("bucket", "_rows", "kind", "common", "conv_id", "top")
        sort = written(looked_up(here.select("bucket", "depth", "seq", "n", "n_turns", "digits", "sizes", "after"), names, ["bucket"], here.count()), "trie-sorted")
        # one sequence: its nodes are a chain, written down chunk by chunk
        alone = sort.where("kind = 'alone'").select("top", "depth", "seq", "n", "n_turns")
        rest = alone.join(chunks, "seq").where("(chunk + 1) * {0} > depth".format(CHUNK))
        below = F.col("after") + F.aggregate(F.slice("sizes", F.col("i") + 1, CHUNK), F.lit(0).cast("long"), lambda s, x: s + x)
        chain = rest.select("*", F.posexplode("digits").alias("i", "_")).withColumn("d", F.col("chunk") * CHUNK + F.col("i") + 1).where("d > depth")
        last = F.col("d") == F.col("n_turns")
        chain = chain.select(
            F.col("seq").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth") + 1, F.col("top")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * below).alias("saved_tokens"), F.when(last, F.col("seq")).alias("end_seq"),
        )
        left = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x) + F.coalesce("after", F.lit(0))
        tops = sort.where("kind = 'alone'").select("bucket", F.when(F.col("n_turns") > F.col("depth"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * left).alias("below"))
        # small buckets: whole sequences meet in a task
        local = sort.where("kind = 'local'").select("bucket", "depth", "top", "seq", "n")
        pieces = local.join(chunks, "seq", "left").where("chunk IS NULL OR (chunk + 1) * {0} > depth".format(CHUNK))
        skipped = F.greatest(F.col("depth") - F.col("chunk") * CHUNK, F.lit(0)).cast("int") + 1
        cut = lambda c: F.coalesce(F.slice(c, skipped, CHUNK), F.array().cast("array<bigint>")).alias(c)
        pieces = pieces.select("bucket", "depth", "top", "seq", "n", F.coalesce("chunk", F.lit(-1)).alias("chunk"), cut("digits"), cut("sizes"))
        # sequences that end at the top have no chunk left and are told by the plan's end_seq
        both = written(pieces.repartition("bucket").sortWithinPartitions("bucket", "seq", "chunk").mapInArrow(_finish, f"bucket string, {_NODE}"), "trie-local")
        tops = tops.unionByName(both.where("bucket IS NOT NULL").select("bucket", "n_children", "n_leaves", F.col("saved_tokens").alias("below")))
        done += [written(chain, "trie-chains"), both.where("bucket IS NULL").drop("bucket")]
        rounds.append((plan, written(tops, "trie-tops")))
        # large buckets: on to the digit after the common prefix
        split = sort.where("kind = 'split'").withColumn("depth", F.col("depth") + F.col("common")).where("n_turns > depth")
        digit = F.get("digits", F.col("common"))
        # at the end of a chunk the bucket itself goes on, under a name of its own
        name = F.sha2(F.concat_ws(",", "bucket", F.col("depth").cast("string"), F.coalesce(digit.cast("string"), F.lit("more"))), 256)
        bottom = F.when(F.col("common") > 0, F.col("conv_id")).otherwise(F.col("top"))
        split = split.select(
            name.alias("name"), F.col("bucket").alias("parent"), bottom.alias("parent_conv"), F.when(digit.isNull(), F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"), "seq", "n", "n_turns",
            F.get("sizes", F.col("common")).alias("size"),
        )
        split = written(split, "trie-split")
        buckets = split.groupBy(F.col("name").alias("bucket"), "parent", "parent_conv", "depth").agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("size").alias("size"))
        buckets = written(buckets.withColumn("top", F.when(F.col("size").isNull(), F.col("parent_conv")).otherwise(F.col("conv_id"))), "trie-buckets")
        old, members = members, split.select(F.col("name").alias("bucket"), "depth", "seq", "n", "n_turns")
        discard(spark, here, sort, old)
    return _gathered(spark, rounds, done, seqs)


def _gathered(spark, rounds: list[tuple[DataFrame, DataFrame]], done: list[DataFrame], seqs: DataFrame) -> DataFrame:
    """Sums up the buckets from the last round to the first, writes down their tops and common prefixes, and adds the ends."""
    totals = None
    for plan, tops in reversed(rounds):
        if totals is not None:
            sums = totals.groupBy(F.col("parent").alias("bucket")).agg(F.sum("children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            tops = tops.unionByName(sums)
        state = plan.join(tops, "bucket")
        # a bucket that only goes on from the end of a chunk (size null) is no node of its own
        state = written(state.withColumn("node", F.col("size").isNotNull()), "trie-state")
        length = F.size("way")
        above = lambda i: (F.col("n_convs") - 1) * F.aggregate(F.slice("way", i + 1, CHUNK), F.lit(0).cast("long"), lambda s, x: s + x)
        # the top (i = 0) and the nodes of the common prefix; the last of them has the children
        line = state.select("*", F.explode(F.sequence(F.lit(0), length)).alias("i")).where("i > 0 OR node")
        bottom = F.col("i") == length
        saved = F.col("below") + above(F.col("i")) + F.when(F.col("i") > 0, (F.col("n_convs") - 1) * F.get("way", F.col("i") - 1)).otherwise((F.col("n_convs") - 1) * F.col("size"))
        parent = F.when(F.col("i") == 0, F.col("parent_conv")).when(F.col("i") == 1, F.col("top")).otherwise(F.col("conv_id"))
        done.append(
            line.select(
                "conv_id", (F.col("depth") + F.col("i")).alias("depth"), parent.alias("parent_conv_id"), "n_convs",
                F.when(bottom, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(bottom, F.col("end_seq")).alias("end_seq"),
            )
        )
        whole = F.col("below") + above(F.lit(0)) + F.when(F.col("node"), (F.col("n_convs") - 1) * F.col("size")).otherwise(0)
        totals = state.where("parent IS NOT NULL").select("parent", F.when(F.col("node") | (length > 0), 1).otherwise(F.col("n_children")).cast("long").alias("children"), "n_leaves", whole.alias("saved"))
    if not done:
        return spark.createDataFrame([], _NODE.replace("end_seq long", "ends_sha256 string"))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    columns = [c.split()[0] for c in _NODE.split(", ")[:-1]]
    ended = nodes.where("end_seq IS NOT NULL").join(seqs.select(F.col("seq").alias("end_seq"), F.col("ends").alias("ends_sha256")), "end_seq")
    return ended.select(*columns, "ends_sha256").unionByName(nodes.where("end_seq IS NULL").select(*columns, F.lit(EMPTY).alias("ends_sha256")))


OP12_SQL = f"""
WITH plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT conv_id, turn, length(text) AS size, md5(strlen(role) || ':' || role || text) AS m FROM plain),
turns AS (SELECT conv_id, size, m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS k FROM keyed),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS head, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
joined AS (SELECT c.conv_id, 0 AS part, k, size, m FROM convs c JOIN turns t ON t.conv_id = c.head AND k < h UNION ALL SELECT c.conv_id, 1, k, size, m FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k >= h),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM joined),
paths AS (SELECT conv_id, d, size, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM ends GROUP BY p, d),
under AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
family AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN under USING (p)),
sums AS (SELECT left(p, 32 * i) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(d + 1)) AS i FROM family) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN sums USING (p) LEFT JOIN nodes u ON f.d > 0 AND u.p = left(f.p, 32 * (f.d - 1))
"""


def op12(spark, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))
