"""Near copies by the Jaccard similarity of word shingles: SetSketch registers, bands, joint likelihood, exact check.

Sketch. Every shingle hash yields an ascending sequence of points with exponential gaps, one for each register and in
an order of its own (an odd stride through the registers); a register keeps its least point, and a shingle stops once
its next point cannot lower any register, so a long text costs little more than one point per shingle. A register is
kept as floor(1 - log_b(least)) cut to 16 bits, b = 1.001: registers of a union are the larger of both, and those of two
sets agree about as often as their Jaccard similarity.

Candidates. Registers are read in `BANDS` bands of `ROWS`; sets that agree in a whole band meet in its bucket. At 0.85
a pair misses all buckets with probability 1e-6 (at 0.8: 2e-4). Two passes avoid the pairs of a bucket: first every
member is compared with the bucket's head, then only members of different components, and of these only with one side
outside the bucket's commonest component. Where that still leaves more than `CROWDED` on the smaller side, only those
members meet that differ from the head in a same shingle, which loses no link (`differing`).

Estimate. From the numbers of registers that are larger, smaller and equal, and both set sizes, follows the likelihood
of every similarity; a pair goes on unless its best similarity is below the bound and e^12.5 likelier than all beyond it.

Check. The whole sets of the pairs that remain are intersected; components of the true links are found by star rounds.

Equal sets are one node. A-Z lower-cased, words between ASCII blanks, fewer than `width` words: the whole sequence as one
shingle; a shingle is known by its XXH64, a set by a 128-bit hash. Texts without a word (NULL and empty ones too) have
the empty set, which links with nothing (`near_groups`) or equals other empty ones (`keep_one`). Rows with the same
identifier are rows of their own; NULL identifiers only name a component that has no other. An empty table gives no
rows. `near_groups` leaves other columns behind, `keep_one` keeps them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, written
from veilspan.llm.components import components
from veilspan.llm.simhash import shingle_hashes, word_runs

LEAST = -(1 << 63)
REGISTERS, BASE, RATE = 256, 1.001, 20.0
TOP = (1 << 16) - 1
ROWS, BANDS = 7, 36
CROWDED = 16
SLOTS = 1 << 24
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


FACTORS = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLD) | np.uint64(1)  # unrelated, so that few sums agree


def shingle_set(text: str, width: int) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    found, last = [], []
    for words in word_runs(text.encode("utf-8", "surrogatepass").lower(), width):
        last = words
        if len(words) >= width:
            found.append(np.unique(shingle_hashes(words, width)))
    if not found and last:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(last), seed=42)], np.uint64))
    return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))


# --- sketches ------------------------------------------------------------------------------------


def least_points(hashes: np.ndarray) -> np.ndarray:
    """The least point of every register; infinite for the empty set."""
    low = np.full(REGISTERS, np.inf)
    own = mixed(hashes ^ GOLD)
    home, stride = (own & np.uint64(REGISTERS - 1)).astype(np.int64), (own >> np.uint64(20) & np.uint64(REGISTERS - 1)).astype(np.int64) | 1
    x, done = np.zeros(len(hashes)), 0
    while len(hashes) and done < REGISTERS:
        # about as many points as all registers need to be met once
        more = min(REGISTERS - done, max(1, 8 * REGISTERS // len(hashes)))
        j = np.arange(done, done + more)
        bits = mixed(hashes[:, None] + (j[None, :] + 1).astype(np.uint64) * GOLD) >> np.uint64(11)
        gaps = -np.log((bits.astype(np.float64) + 0.5) * 2.0**-53) / (RATE * (REGISTERS - j))
        points = x[:, None] + np.cumsum(gaps, axis=1)
        np.minimum.at(low, ((home[:, None] + stride[:, None] * j[None, :]) & (REGISTERS - 1)).ravel(), points.ravel())
        x, done = points[:, -1], done + more
        go_on = np.flatnonzero(x < low.max())
        hashes, home, stride, x = hashes[go_on], home[go_on], stride[go_on], x[go_on]
    return low


def registers(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least_points(hashes)) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD).astype(np.int64)


def likelihoods(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood of every similarity of `grid` (columns) for every pair (rows), from the numbers of registers that are
    larger and smaller in the first set and from both sizes; -inf where sets of these sizes can't be so similar."""
    u = (n_a / (n_a + n_b))[:, None]
    j = grid[None, :]
    more, less = u - (1 - u) * j, (1 - u) - u * j
    possible = (more >= -1e-12) & (less >= -1e-12)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = chance(more), chance(less)
    p, q, e = np.maximum(p, 1e-12), np.maximum(q, 1e-12), np.maximum(1 - p - q, 1e-12)
    larger, smaller = larger[:, None], smaller[:, None]
    return np.where(possible, larger * np.log(p) + smaller * np.log(q) + (REGISTERS - larger - smaller) * np.log(e), -np.inf)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, odds: float = 12.5) -> np.ndarray:
    """Which pairs of registers do not rule `percent` out. The grid holds the bound itself, and the greatest
    similarity that a pair's sizes allow is taken as one with it if it lies between two values."""
    grid = np.unique(np.concatenate([np.linspace(0, 1, 101), [percent / 100]]))
    log = likelihoods((a > b).sum(axis=1), (a < b).sum(axis=1), n_a.astype(np.float64), n_b.astype(np.float64), grid)
    return log[:, grid >= percent / 100 - 1e-9].max(axis=1) >= log.max(axis=1) - odds


# --- rows and nodes ------------------------------------------------------------------------------


def known(docs: DataFrame) -> DataFrame:
    """(id, th, text): th is a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, th, n, same, keys, regs) of every row: size and 128-bit hash of its set, band keys, registers."""

    def run(batches):
        for b in batches:
            n, same, keys, regs = [], [], [], []
            for text in column(b, "text"):
                h = shingle_set(text, width)
                r = registers(h)
                n.append(len(h))
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(band_keys(r) if len(h) else np.zeros(0, np.int64))
                regs.append(r.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                names=["id", "th", "n", "same", "keys", "regs"],
            )

    return known(docs).mapInArrow(run, "id long, th long, n long, same binary, keys array<long>, regs binary")


def alike(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


# --- candidates ----------------------------------------------------------------------------------


def stars(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each bucket's head and its other members, and the entries (key, node, n, head) of buckets with more
    than one node. The head is the member that meets most others over all its buckets: the middle of a group of copies."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    # a merge hint where Spark sizes keys like the rows or sets they come from, some ten times too low, and would broadcast them
    met = written(entries.join(sizes.hint("merge"), "key"), "sketch-met")
    met = met.join(met.groupBy("node").agg(F.sum("rows").alias("score")), "node")
    heads = met.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("head"))
    met = written(met.join(heads, "key").select("key", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "sketch-entries")
    pairs = met.where((F.col("node") != F.col("head")) & alike(F.col("n"), F.col("head_n"), percent))
    return pairs.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), met


def across(entries: DataFrame, percent: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """For entries (key, node, n, label): pairs (a, b) of a bucket whose labels differ, and the keys of crowded buckets (more
    than `most` nodes outside the commonest label), whose pairs are not given. One of the two is outside the commonest
    label, so a large component is never paired with itself. Entries of `differing` also bring (d, at): a pair whose
    differences can't share enough from these places on is no candidate here."""
    by = entries.groupBy("key", "label").agg(F.count("*").alias("rows"))
    of = by.groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("common"), (F.sum("rows") - F.max("rows")).alias("others")).where("others > 0")
    of = written(of, "sketch-buckets")
    fit = of if most is None else of.where(F.col("others") <= most)
    all_rows = entries.join(fit.select("key", "common"), "key")
    own = [c for c in entries.columns if c != "key"]
    few = all_rows.where("label <> common").select("key", *[F.col(c).alias("x" if c == "node" else f"x_{c}") for c in own])
    many = all_rows.select("key", "common", *[F.col(c).alias("y" if c == "node" else f"y_{c}") for c in own])
    once = (F.col("y_label") == F.col("common")) | (F.col("x") < F.col("y"))
    met = (F.col("x_label") != F.col("y_label")) & once & alike(F.col("x_n"), F.col("y_n"), percent)
    if "at" in own:
        left = F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at"))
        met &= 2 * left * (100 + percent) >= (F.col("x_d") + F.col("y_d")) * (100 + percent) - (F.col("x_n") + F.col("y_n")) * (100 - percent)
    pairs = few.join(many, "key").where(met)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), of.join(fit, "key", "left_anti").select("key")


def marked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (id, th, text) of `docs` whose identifier and text hash fall into a slot of one of `rows` (w_id, w_th). The slots
    are bits of SLOTS / 64 words at most, a table that is broadcast whatever the size of `rows`."""

    def slot(*key: str) -> Column:
        return F.xxhash64(*key).bitwiseAND(SLOTS - 1)

    taken = rows.select(slot("w_id", "w_th").alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    taken = taken.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = known(docs).withColumn("slot", slot("id", "th")).withColumn("word", F.shiftright("slot", 6))
    return texts.join(F.broadcast(taken), "word").where(F.bit_get("bits", F.col("slot").bitwiseAND(63).cast("int")) == 1).select("id", "th", "text")


def whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, set) of the nodes in `wanted`, each read from its first row's text. Texts that can't be wanted stay where they are."""

    def sets(batches):
        for b in batches:
            found = [shingle_set(t, width).astype(np.int64) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    rows = wanted.join(nodes, "node").select("node", F.col("first.id").alias("w_id"), F.col("first.th").alias("w_th"))
    rows = written(rows, "sketch-wanted")  # where few, its size lets Spark broadcast it
    texts = marked(docs, rows).join(rows, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("node", "text")
    return written(texts.mapInArrow(sets, "node long, set array<long>").dropDuplicates(["node"]), "sketch-sets")


def differing(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For (head, node, n, label): entries under the shingles that only one of head and node has, with their number d and
    each one's place `at` among them, rarest first.

    Two nodes differ in d_x + d_y - 2s shingles, s of which both differ from the head in; that they are alike asks for a
    least s. The first place they share then leaves s places in both lists (`across`). Of two nodes of different
    components one is not alike to the head (those that are go to the check as pairs with it, `stars` and `gathered`), so s is
    more than half of d_y + c(n_head - n_y), c = (100 - percent) / (100 + percent): members of the head's own component are
    entered only under the places that leave as many. No link is lost."""
    s, t = sets.toDF("node", "set"), sets.toDF("head", "head_set")
    home = members.select(F.col("node").alias("head"), F.col("label").alias("home")).distinct()
    either = F.array_union(F.array_except("set", "head_set"), F.array_except("head_set", "set"))
    own = ["head", "node", "n", "label", "head_n", "inside"]
    apart = members.join(home, "head").join(s, "node").join(t, "head").select(
        "head", "node", "n", "label", F.size("head_set").cast("long").alias("head_n"), (F.col("label") == F.col("home")).alias("inside"), F.explode(either).alias("shingle"))
    apart = written(apart.select(*own, F.xxhash64("head", "shingle").alias("key")), "sketch-apart")
    often = apart.groupBy("key").agg(F.count("*").alias("often"))
    # one node's own shingles, never more than two sets hold
    ranked = apart.join(often.hint("merge"), "key").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("keys"))
    placed = ranked.select(*own, F.size("keys").cast("long").alias("d"), F.posexplode("keys").alias("at", "k"))
    left = 2 * (F.col("d") - F.col("at")) * (100 + percent) > F.col("d") * (100 + percent) + (F.col("head_n") - F.col("n")) * (100 - percent)
    return placed.where(~F.col("inside") | left).select(F.col("k.key").alias("key"), "node", "n", "label", "d", F.col("at").cast("long").alias("at"))


def gathered(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (head, node, n, label) of crowded buckets under fewer heads, and the pairs (a, b) of these heads and their new
    members. A head's members all go to the head with most members that it has met itself, so nodes that meet in several
    buckets come under one head instead of one for each, and no two that met are parted."""
    size = members.groupBy("head").agg(F.count("*").alias("rows"))
    to = members.join(size, "head").groupBy("node").agg(F.max_by("head", F.struct("rows", "head")).alias("to")).toDF("head", "to")
    fewer = written(members.join(to, "head").select(F.col("to").alias("head"), "node", "n", "label").distinct(), "sketch-gathered")
    own = members.select(F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("label").alias("home")).distinct()
    pairs = fewer.join(own, "head").where((F.col("label") != F.col("home")) & alike(F.col("n"), F.col("head_n"), percent))
    return fewer, pairs.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity."""

    def likely(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(column(b, c)), np.uint16).reshape(-1, REGISTERS) for c in ("a_regs", "b_regs"))
            ok = may_reach(x, y, np.array(column(b, "a_n"), np.int64), np.array(column(b, "b_n"), np.int64), percent) if b.num_rows else []
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("regs").alias(f"{c}_regs")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").where(alike(F.col("a_n"), F.col("b_n"), percent)).select("a", "b", "a_n", "b_n", "a_regs", "b_regs")
    hopeful = written(both.mapInArrow(likely, "a long, b long"), "sketch-pairs")
    wanted = hopeful.select(F.col("a").alias("node")).union(hopeful.select(F.col("b").alias("node"))).distinct()
    whole = whole_sets(wanted, nodes, docs, width)
    s, t = whole.toDF("a", "a_set"), whole.toDF("b", "b_set")
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    counted = hopeful.join(s, "a").join(t, "b").select("a", "b", (F.size("a_set") + F.size("b_set")).cast("long").alias("sizes"), shared.alias("shared"))
    return written(counted.where(F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).select("a", "b"), "sketch-links")


def groups(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, th, n, same, …), nodes (node, same, n, first, …), and (node, root) of every node that links with another
    one and is not the least of its component."""
    rows = written(sketched(docs, width), "sketch-rows")
    nodes = rows.groupBy("same").agg(F.min(F.struct("id", "th")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("regs").alias("regs"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    pairs, met = stars(nodes.select(F.explode("keys").alias("key"), "node", "n"), percent)
    near = compared(pairs, nodes, docs, width, percent)
    labels = components(near).toDF("l_node", "root")
    entries = met.join(labels, F.col("node") == F.col("l_node"), "left").select("key", "node", "n", "head", F.coalesce("root", "node").alias("label"))
    entries = written(entries, "sketch-labels")
    rest, crowded = across(entries.drop("head"), percent, CROWDED)
    crowded = written(crowded, "sketch-crowded")
    if not crowded.isEmpty():
        members = written(entries.join(crowded, "key", "left_semi").select("head", "node", "n", "label").distinct(), "sketch-members")
        members, direct = gathered(members, percent)
        some = members.select("node").union(members.select("head")).distinct()
        split = written(differing(members, whole_sets(some, nodes, docs, width), percent), "sketch-differing")
        rest = rest.unionByName(direct).unionByName(across(split, percent, None)[0]).distinct()
    far = compared(rest, nodes, docs, width, percent)
    return rows, nodes, components(near.unionByName(far))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (the smallest identifier reachable) and kept (its own is that one).
    A row without words is a component of its own."""
    rows, nodes, of = groups(docs, width, percent)
    named = nodes.join(of.toDF("o_node", "root"), F.col("node") == F.col("o_node"), "left").select("same", "first", F.coalesce("root", "node").alias("label"))
    whole = named.groupBy("label").agg(F.min("first.id").alias("component_id"))
    whole = named.select("same", "label").join(whole, "label").select("same", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = rows.select("id", "n", "same").join(whole, "same").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(__id, __th) of the row with the smallest doc_id of every component (of equal ids the one whose text hashes lowest). A
    NULL id counts as the smallest; rows without words are one component."""
    rows, nodes, of = groups(docs, width, percent)
    row = F.min(F.struct(F.col("first.id").alias("__id"), F.col("first.th").alias("__th"))).alias("row")
    stay = nodes.join(of.toDF("o_node", "root"), F.col("node") == F.col("o_node"), "left").groupBy(F.coalesce("root", "node")).agg(row)
    return stay.select(F.coalesce("row.__id", F.lit(LEAST)).alias("__id"), "row.__th")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The representatives' rows (of rows alike in id and text, one), with all columns of `docs`."""
    stay, own = representatives(docs, width, percent), {c: f"__{c}_{len(docs.columns)}" for c in ("id", "th")}
    while set(own.values()) & set(docs.columns):
        own = {c: f"_{v}" for c, v in own.items()}
    keyed = docs.withColumns({own["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), own["th"]: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return keyed.join(stay.toDF(*own.values()), list(own.values()), "left_semi").dropDuplicates(list(own.values())).select(*docs.columns)
