"""Operator 5: near-duplicate documents by an exact n-gram Jaccard join with vertical partitioning.

The global order of n-grams (by hash) is cut into fragments. Every map task cuts the shingle sets of its texts at the
fragments and sends each fragment one packed block; where the data need more than ``2 ** packets.STEP_BITS`` fragments,
further steps cut each again, so blocks grow in proportion to the text. A fragment counts, for its n-grams, the different
sets that hold them; n-grams of one set only can never overlap and leave. Per set the fragments' counts are summed: a set
with less than the threshold's share of shared n-grams has no partner and leaves. N-grams that a sample shows to be in very
many texts (``hot_tokens``) are not gathered in a fragment: they count as shared and go straight to the parts of their sets. Equal sets are one set throughout (their
documents link). N-grams are compared by hashes of 48 bits and more, as their number grows.

Candidates among the remaining sets come from prefix filtering: in the order of rising frequency, two sets that link share
one of their first ``r - ceil(t n) + 1`` shared n-grams. A bucket of one n-gram is not expanded into its pairs: its members
meet one centre, and links merge components. Sets that still share a bucket with another component meet in blocks: tasks
of bounded size count overlaps and let only links between different components out, so no such link is lost and no
quadratic number of rows arises. Verifying counts partial overlaps fragment by fragment and sums them per pair. Joins on
an n-gram, a set or a component salt the keys that hold many rows.

Defined results: null, empty and wordless texts have no shingle and stand alone; fewer than five words are one shingle;
equal rows link; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import packets, shared, textblocks
from loomstone.llm.components import components
from loomstone.llm.packets import narrow, pack, unpack

WORDS = 5
#: Jaccard of at least 75 / 100: overlap / union, so 7 * overlap >= 3 * (size + size).
NUM, DEN = 75, 100
CUTS = 4


def signatures(owner: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a 64-bit signature of its set (0 without shingles) and the set's size."""
    size = np.bincount(owner, minlength=n).astype(np.int32)
    total = np.zeros(n, np.uint64)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[first]] = np.add.reduceat(textblocks.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
    sig = textblocks.mix(total + size.astype(np.uint64)).astype(np.int64)
    return np.where(size > 0, sig, 0), size


def packed(sig: np.ndarray, size: np.ndarray, owner: np.ndarray, token: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """N-grams in ascending order with the sets that hold them; of the sets only those that occur."""
    present, ref = np.unique(owner, return_inverse=True)
    return pack(sig[present], size[present], narrow(np.diff(token, prepend=np.uint64(0))), narrow(ref), *([] if df is None else [narrow(df)]))


def gathered(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of all packets the distinct signatures and their sizes, then the number of each entry's set, its n-gram and its df."""
    parts = [unpack(p) for p in payloads]
    sig, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    base = np.cumsum([0, *[len(p[0]) for p in parts]])
    owner = np.concatenate([inverse[b + p[3].astype(np.int64)].astype(np.int32) for p, b in zip(parts, base, strict=False)])
    token = np.concatenate([np.cumsum(p[2].astype(np.uint64)) for p in parts])
    df = np.concatenate([p[4] for p in parts]) if len(parts[0]) > 4 else None
    return sig, np.concatenate([p[1] for p in parts])[first], owner, token, df


def dealt(parent: int, step: int, part: np.ndarray, sig: np.ndarray, size: np.ndarray, owner: np.ndarray, token: np.ndarray, df: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """One packet for each value of ``part`` (below ``2 ** step``) that occurs; entries come in ascending order of n-grams."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange((1 << step) + 1))
    out = []
    for g in np.flatnonzero(np.diff(edges)).tolist():
        here = order[edges[g] : edges[g + 1]]
        out.append((parent << step | g, packed(sig, size, owner[here], token[here], None if df is None else df[here])))
    return out


def by_token(bits: int, done: int, step: int):
    """Which part an n-gram of ``bits`` bits belongs to, after ``done`` bits."""
    return lambda sig, token: (token >> np.uint64(bits - done - step)).astype(np.int64) & ((1 << step) - 1)


def by_set(done: int, step: int):
    """Which part a set belongs to, after ``done`` bits of its signature."""
    return lambda sig, token: (sig.view(np.uint64) >> np.uint64(64 - done - step)).astype(np.int64) & ((1 << step) - 1)


PACKETS = "frag long, payload binary"
#: Added to the parts of entries whose n-gram is hot: these are dealt by set from the start.
HOT = 1 << 60
#: The number of sets taken for a hot n-gram: hot ones come last in the order of rising frequency.
OFTEN = 1 << 30


def _deal(route, done: int, step: int):
    """The packets of one part and group, dealt by ``step`` more bits."""

    def run(key, group):
        shared.tidy()
        frag, payloads = key[0].as_py(), group["payload"].to_pylist()
        if frag < 0:
            return _rows([frag] * len(payloads), payloads)
        sig, size, owner, token, df = gathered(payloads)
        order = np.argsort(token, kind="stable")
        owner, token, df = owner[order], token[order], None if df is None else df[order]
        where, base = (by_set(done, step), HOT) if frag >= HOT else (route(done, step), 0)
        out = dealt(frag - base, step, where(sig[owner], token), sig, size, owner, token, df)
        return _rows([base + f for f, _ in out], [x for _, x in out])

    return run


def again(blocks: DataFrame, route, plan: list[int], inputs: int) -> DataFrame:
    """The packets of ``blocks`` dealt by the further steps of ``plan``, groups of them at a time.

    ``route(done, step)`` says where an entry goes. ``inputs`` is about how many packets a part holds; a group takes as many
    as the step before was wide. Negative parts pass unchanged.
    """
    done = plan[0]
    for before, step in zip(plan[:-1], plan[1:], strict=True):
        inputs = max(1, inputs >> before)
        group = F.pmod(F.xxhash64("payload"), F.lit(inputs)).alias("group")
        blocks = blocks.groupBy("frag", group).applyInArrow(_deal(route, done, step), PACKETS)
        done += step
    return blocks


def hot_tokens(docs: DataFrame, bits: int, total: int, *, key: str, text: str, sample: int = 32, least: int = 2000) -> np.ndarray:
    """The n-grams (ascending) that one in ``sample`` documents shows to be in more than ``least`` texts, or one in 2 ** 20 of all entries.

    So there are about a million at most, whatever the input. Which n-grams are found changes how entries travel and in
    which order a set's n-grams stand, not which sets link; one that is missed is gathered in its fragment.
    """
    most = max(least, total // 6 >> 20)

    def run(batches):
        for b in batches:
            held = [textblocks.shingles(*textblocks.words(raw, offsets), WORDS)[1] for _, _, raw, offsets in textblocks.blocks(b.column(0))]
            code, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]) >> np.uint64(64 - bits), return_counts=True)
            yield pa.record_batch({"token": pa.array(code.astype(np.int64)), "n": pa.array(count)})

    part = docs.where(F.pmod(F.xxhash64(key, text), F.lit(sample)) == 0).select(F.col(text).alias("t"))
    counted = part.mapInArrow(shared.worker(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") * sample >= 0.75 * most).select("token").toArrow()
    return np.sort(found["token"].to_numpy().astype(np.uint64))


def _is_in(token: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(token), bool)
    return among[np.minimum(np.searchsorted(among, token), len(among) - 1)] == token


def cut(docs: DataFrame, bits: int, step: int, *, key: str, text: str, hot: np.ndarray | None = None, hold: int = 800_000) -> DataFrame:
    """(frag, payload): packed n-grams with their sets per fragment, and the documents' signatures below 0.

    Entries of ``hot`` n-grams, which no fragment could hold, go to the parts of their sets (from ``HOT`` on) at once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if hot is None else hot)

    def run(batches):
        among = sent.value
        part, turn = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = 0

        def blocks():
            nonlocal turn
            keys, sig, size = (np.concatenate([h[i] for h in held]) for i in range(3))
            base = np.cumsum([0, *[len(h[0]) for h in held]])
            owner = np.concatenate([h[3] + np.int32(b) for h, b in zip(held, base, strict=False)])
            token = np.concatenate([h[4] for h in held])
            rows = [(-1 - (part * 65536 + turn), pack(keys, np.concatenate([h[5] for h in held]), sig, size))]
            turn += 1
            _, first = np.unique(sig, return_index=True)
            once = np.zeros(len(sig), bool)
            once[first] = True
            keep = once[owner]
            owner, token = owner[keep], token[keep] >> np.uint64(64 - bits)
            order = np.argsort(token)
            owner, token = owner[order], token[order]
            often = _is_in(token, among)
            if often.any():
                who, what = owner[often], token[often]
                rows += [(HOT + f, x) for f, x in dealt(0, step, by_set(0, step)(sig[who], what), sig, size, who, what, np.full(len(what), OFTEN))]
                owner, token = owner[~often], token[~often]
            rows += dealt(0, step, by_token(bits, 0, step)(sig, token), sig, size, owner, token)
            return _rows(*zip(*rows, strict=True)).to_batches()[0]

        for b in batches:
            keys = b.column(0)
            present = np.array(keys.is_valid())
            numbers = keys.fill_null(0).to_numpy()
            for first, last, raw, offsets in textblocks.blocks(b.column(1)):
                owner, token = textblocks.shingles(*textblocks.words(raw, offsets), WORDS)
                sig, size = signatures(owner, token, last - first)
                held.append((numbers[first:last], sig, size, owner.astype(np.int32), token, present[first:last].astype(np.uint8)))
                count += len(token) + last - first
                if count >= hold:
                    yield blocks()
                    held, count = [], 0
                    shared.trim()
        if held:
            yield blocks()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(shared.worker(run), PACKETS)


def _rows(frag, payload) -> pa.Table:
    return pa.table({"frag": pa.array(frag, pa.int64()), "payload": pa.array(payload, pa.binary())})


def shared_tokens(blocks: DataFrame, step: int) -> DataFrame:
    """Per fragment, the n-grams of at least two sets with that number of sets, dealt by the set that holds them."""

    def run(key, group):
        shared.tidy()
        payloads = group["payload"].to_pylist()
        if key[0].as_py() < 0:
            return _rows([key[0].as_py()] * len(payloads), payloads)
        sig, size, owner, token, df = gathered(payloads)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        if df is not None:  # hot n-grams of this part's sets: equal sets of several tasks are one
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            first = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
            token, owner = token[first], owner[first]
            return _rows(*zip(*dealt(0, step, by_set(0, step)(sig[owner], None), sig, size, owner, token, np.full(len(token), OFTEN)), strict=True))
        new = np.concatenate([[True], token[1:] != token[:-1]])
        group_of = np.cumsum(new) - 1
        many = np.bincount(group_of) > 1
        keep = many[group_of]
        pairs = np.unique(group_of[keep] * len(sig) + owner[keep].astype(np.int64))
        which, who = pairs // len(sig), pairs % len(sig)
        df = np.bincount(which, minlength=len(many))
        keep = df[which] > 1
        which, who = which[keep], who[keep]
        out = dealt(0, step, by_set(0, step)(sig[who], None), sig, size, who, token[new][which], np.minimum(df[which], OFTEN - 1))
        return _rows(*zip(*out, strict=True)) if out else _rows([], [])

    return blocks.groupBy("frag").applyInArrow(run, PACKETS)


SETS = "doc_id long, sig long, n int, r int, tokens array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("r", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def sets(parts: DataFrame) -> DataFrame:
    """Documents (doc_id, sig, n) and, with ``r`` set, the sets that may have a partner, n-grams by rising frequency."""

    def run(key, group):
        shared.tidy()
        payloads = group["payload"].to_pylist()
        if key[0].as_py() < 0:
            keys, present, sig, size = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
            none = pa.nulls(len(sig), pa.int32())
            return pa.Table.from_arrays([pa.array(keys, pa.int64(), mask=present == 0), pa.array(sig), pa.array(size, pa.int32()), none, pa.nulls(len(sig), pa.list_(pa.int64()))], schema=_SETS)
        sig, size, owner, token, df = gathered(payloads)
        count = np.bincount(owner, minlength=len(sig))
        good = count * DEN >= size.astype(np.int64) * NUM
        keep = good[owner]
        owner, token, df = owner[keep], token[keep], df[keep]
        order = np.lexsort((token, df, owner))
        lengths = count[good]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(token[order].astype(np.int64)))
        n = int(good.sum())
        return pa.Table.from_arrays([pa.nulls(n, pa.int64()), pa.array(sig[good]), pa.array(size[good], pa.int32()), pa.array(lengths, pa.int32()), lists], schema=_SETS)

    return parts.groupBy("frag").applyInArrow(run, SETS)


def may_link(n1: Column, r1: Column, n2: Column, r2: Column) -> Column:
    """What sizes and numbers of shared n-grams allow: the smaller number is the most that can overlap."""
    return F.least(r1, r2) * (DEN + NUM) >= (n1 + n2) * NUM


def verify(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps counted per fragment of the order, then summed per pair.

    A centre is in many pairs: its pieces are repeated and its pairs salted.
    """
    left = pieces.select(F.col("sig").alias("a"), "v", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = pieces.select(F.col("sig").alias("b"), "v", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    parted = pairs.select("a", "b", F.explode(F.array(*map(F.lit, range(CUTS)))).alias("v"))
    counted = shared.salted(parted, right, ["b", "v"], shared.hot(pairs, "b"))
    counted = shared.salted(counted, left, ["a", "v"], shared.hot(pairs, "a")).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
    summed = counted.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return summed.where((F.col("na") + F.col("nb") - F.col("overlap")) * NUM <= F.col("overlap") * DEN).select("a", "b")


def distinct_buckets(index: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``index`` with one n-gram per set of members, and only n-grams that two sets or more hold; then the hot n-grams."""
    members = index.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y"))
    kept = shared.written(members.where("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m"), "tokens")
    heavy = shared.hot(kept, "token", "m")
    return shared.written(shared.salted(index, kept.select("token"), ["token"], heavy), "buckets"), heavy


def against_centres(index: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of each bucket's centre, the set with the fewest n-grams of its own, and the other members."""
    centre = index.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("own"), F.xxhash64("sig").alias("h"), "sig", "n", "r")).alias("z"))
    pairs = shared.salted(index, centre, ["token"], heavy).where((F.col("sig") != F.col("z.sig")) & may_link(F.col("n"), F.col("r"), F.col("z.n"), F.col("z.r")))
    return pairs.select(F.least("sig", "z.sig").alias("a"), F.greatest("sig", "z.sig").alias("b")).distinct()


def open_members(index: DataFrame, labels: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(sig, n, comp, clump) of the sets that still share a bucket with a set of another component and may link there.

    A clump holds all sets that such buckets connect, so two sets of different clumps never link.
    """
    seen = index.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    mixed = lambda rows: rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n")).where("lo <> hi").select("token", "least_n")
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * NUM / F.lit(DEN)))
    able = shared.salted(seen, mixed(seen), ["token"], heavy).where(F.col("r") * (DEN + NUM) >= (F.col("n") + smallest) * NUM).drop("least_n")
    able = shared.written(able, "able")
    rows = shared.salted(able, mixed(able).select("token"), ["token"], heavy)
    hub = rows.groupBy("token").agg(F.min("sig").alias("hub"))
    clumps = components(shared.salted(rows, hub, ["token"], heavy).where("sig <> hub").select("hub", "sig"), "hub", "sig").withColumnsRenamed({"node": "sig", "comp": "clump"})
    return rows.select("sig", "n", "comp").distinct().join(clumps, "sig")


def block_links(members: DataFrame, kept: DataFrame, *, block: int = 512, bin_sets: int = 2000) -> DataFrame:
    """Links (a, b) between different components of a clump, found in blocks of at most about ``block`` sets against blocks.

    A clump of more sets is dealt into blocks by hash and every two blocks meet in a task of their own, so each of its sets
    is sent to as many tasks as the clump has blocks; small clumps share tasks. In a task partial overlaps are counted fragment by fragment of the n-gram order and summed per pair; only links
    that join components leave it.
    """
    sized = members.groupBy("clump").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    bins = max(1, members.count() // bin_sets)
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = shared.salted(members, sized, ["clump"], shared.hot(members, "clump")).withColumn("own", own).withColumn("other", other)
    small = F.col("blocks") == 1
    task = F.struct(F.when(small, F.pmod(F.xxhash64("clump"), F.lit(bins))).otherwise(F.col("clump")).alias("at"), small.alias("small"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.select(F.to_json(task).alias("task"), "clump", "sig", "n", "comp", "own").join(kept.select("sig", "tokens"), "sig")

    def run(group):
        shared.tidy()
        found: list[tuple[int, int]] = []
        clump = group["clump"].to_numpy()
        order = np.argsort(clump, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(clump[order]) != 0, [True]]))
        lists = group["tokens"].combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sig, n, comp, side = (group[c].to_numpy() for c in ("sig", "n", "comp", "own"))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            rows_ = order[x:y]
            found += _links(rows_, sig, n.astype(np.int64), comp, side, [flat[offsets[i] : offsets[i + 1]] for i in rows_])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _links(rows, sig, n, comp, side, sets_, cut: int = 4096) -> list[tuple[int, int]]:
    """Pairs of one clump's rows that link and join two components, each join once."""
    m = len(rows)
    token, owner = np.concatenate(sets_), np.repeat(np.arange(m), [len(s) for s in sets_])
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    many = count[column] > 1
    column, owner = np.unique(column[many], return_inverse=True)[1], owner[many]
    overlap = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, cut):
        a, b = np.searchsorted(column, [at, at + cut])
        part = np.zeros((m, min(cut, int(column[b - 1]) - at + 1)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        overlap += part @ part.T
    size = n[rows]
    good = np.triu((overlap * (DEN + NUM) >= (size[:, None] + size[None, :]) * NUM) & (comp[rows][:, None] != comp[rows][None, :]), 1)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        x, y = find(int(comp[rows[i]])), find(int(comp[rows[j]]))
        if x != y:
            root[x] = y
            out.append((int(sig[rows[i]]), int(sig[rows[j]])))
    return out


def link(kept: DataFrame, bits: int) -> DataFrame:
    """(node, comp) of the sets that link with another set; n-grams have ``bits`` bits."""
    least = F.floor((F.col("n") * NUM + DEN - 1) / DEN).cast("int")
    parts = F.transform(F.array(*map(F.lit, range(CUTS))), lambda v: F.struct(v.alias("v"), F.filter("tokens", lambda t: F.floor(t * (CUTS / 2.0**bits)) == v).alias("tokens")))
    pieces = kept.select("sig", "n", F.explode(parts).alias("p")).select("sig", "n", "p.v", "p.tokens")
    index, heavy = distinct_buckets(kept.select("sig", "n", "r", F.explode(F.slice("tokens", F.lit(1), F.col("r") - least + 1)).alias("token")))
    found = shared.written(verify(shared.written(against_centres(index, heavy), "candidates"), pieces), "verified")
    labels = components(found)
    members = shared.written(open_members(index, labels, heavy), "open")
    if members.isEmpty():
        return labels
    more = shared.written(block_links(members, kept), "verified")
    if more.isEmpty():
        return labels
    return components(found.unionByName(more))


def cluster(docs: DataFrame, *, key: str = "doc_id", text: str = "text", fragment_bytes: int = 10 << 20, step_bits: int = packets.STEP_BITS, hot_least: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row.

    ``hot_least`` sets from how many texts on an n-gram counts as hot, over all texts instead of a sample.
    """
    shared.small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = packets.hash_bits(total // 2)
    plan = packets.steps(max(2, packets.bits_for(-(-total // fragment_bytes))), step_bits)
    inputs = 1 << sum(plan)
    often = hot_tokens(docs, bits, total, key=key, text=text, **({} if hot_least is None else {"sample": 1, "least": hot_least}))
    blocks = again(cut(docs, bits, plan[0], key=key, text=text, hot=often), lambda done, step: by_token(bits, done, step), plan, inputs)
    dealt_sets = again(shared_tokens(blocks, plan[0]), by_set, plan, inputs)
    made = shared.written(sets(dealt_sets), "sets")
    labels = link(made.where("r IS NOT NULL").select("sig", "n", "r", "tokens"), bits)
    rows = made.where("r IS NULL").select("doc_id", "sig", F.col("n").cast("long").alias("n_shingles"))
    classes = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    classes = shared.written(classes.select("sig", "least", "m", F.coalesce("comp", "sig").alias("comp")), "classes")
    lowest = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = shared.salted(classes, lowest, ["comp"], shared.hot(classes, "comp")).select("sig", "component_id")
    joined = shared.salted(rows, named, ["sig"], shared.hot(classes, "sig", "m"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose key is the least of its component; of rows with equal keys and texts one stays.

    A key stands for its document: if one of the rows of a key is a copy of a lesser key, all of them go. A row without a
    key is one of its own and comes after all keys. Texts are shuffled only for keys that occur more than once; the keys to
    drop are broadcast where their counted number is within ``broadcast_rows``.
    """
    keyless = docs.where(F.col(key).isNull())
    if keyless.isEmpty():
        return _kept(docs, key, text, broadcast_rows)
    number = shared.free_name(docs, "number")
    top = F.lit(docs.agg(F.max(F.col(key).cast("long"))).first()[0] or 0)
    named = shared.written(keyless.withColumn(number, top + 1 + F.monotonically_increasing_id()), "keyless")
    return _kept(docs.where(F.col(key).isNotNull()).withColumn(number, F.col(key).cast("long")).unionByName(named), number, text, broadcast_rows).drop(number)


def _kept(docs: DataFrame, key: str, text: str, broadcast_rows: int) -> DataFrame:
    node = shared.free_name(docs, "node")
    classes = shared.written(cluster(docs, key=key, text=text).select(F.col("doc_id").alias(node), (F.col("component_id") != F.col("doc_id")).alias("copy")), "classes")
    gone = shared.written(classes.where("copy").select(node).distinct(), "copies")
    fit = F.broadcast if gone.count() <= broadcast_rows else lambda x: x
    kept = docs.join(fit(gone), docs[key].cast("long") == F.col(node), "left_anti")
    twice = shared.written(classes.groupBy(node).count().where("count > 1").select(node), "repeated")
    if twice.isEmpty():
        return kept
    at = kept[key].cast("long") == F.col(node)
    return kept.join(twice, at, "left_anti").unionByName(kept.join(twice, at, "left_semi").dropDuplicates([key, text]))


#: The same rows in DuckDB: all pairs by shared shingles, then reachability.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 75 * (s.n + t.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
