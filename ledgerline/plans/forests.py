"""Forests as tables of nodes, their scores and importances; SQL grows the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.features import split_part
from ledgerline.operators.forest import Forest, Slots, grow, importances, weights, with_leaves, with_shares
from ledgerline.session import settle_columns
from ledgerline.sources import read_table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
TEXTS = ["l_linestatus", "l_shipmode"]
SEED = 7
TREES, DEPTH, MIN_LEAF, PER_NODE = 5, 3, 20, 3


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Which lines were returned; two texts beside the numbers."""
    lines = read_table(spark, folder, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line")
    mode = F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("l_shipmode")
    return lines.select(key, (F.col("l_returnflag") == "R").cast("int").alias("returned"), *NUMBERS, "l_linestatus", mode)


def _binned(spark: SparkSession, folder: str) -> tuple[Slots, DataFrame, DataFrame]:
    """Slots, and the training and test rows by their bins; the training rows are settled, as every level reads them."""
    rows = settle_columns(_lines(spark, folder).withColumn("part", split_part("line")))
    train = rows.where("part = 'train'")
    slots = Slots.fit(train, NUMBERS, TEXTS)
    binned = slots.transform(train).select("line", "returned", "l_discount", *slots.names)
    return slots, settle_columns(binned), slots.transform(rows.where("part = 'test'"))


def _forest(slots: Slots, train: DataFrame) -> Forest:
    drawn = train.withColumn("drawn", weights("line", TREES, SEED))
    return grow(
        drawn, slots.names, slots.by_level, "returned", 2, TREES, DEPTH, MIN_LEAF, slots.max_bins, per_node=PER_NODE, drawn="drawn", seed=SEED
    )


def _tree(slots: Slots, train: DataFrame, depth: int = DEPTH) -> Forest:
    return grow(train, slots.names, slots.by_level, "returned", 2, 1, depth, MIN_LEAF, slots.max_bins)


def _nodes(forest: Forest) -> DataFrame:
    found = forest.table()
    return found.select(
        "tree", "node", "slot", "bin", F.round("gain", 6).alias("gain"), F.get("sums", F.lit(0)).alias("n_0"), F.get("sums", F.lit(1)).alias("n_1")
    )


def _scored(slots: Slots, test: DataFrame, forest: Forest) -> DataFrame:
    placed = with_shares(with_leaves(test, forest, slots.names, slots.by_level), forest, 2)
    return placed.select("line", F.round(F.get("shares", F.lit(1)), 9).alias("probability"))


def forest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    slots, train, _ = _binned(spark, folder)
    return _nodes(_forest(slots, train))


def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    slots, train, test = _binned(spark, folder)
    return _scored(slots, test, _forest(slots, train))


def forest_importances(spark: SparkSession, folder: str) -> DataFrame:
    slots, train, _ = _binned(spark, folder)
    found = importances(_forest(slots, train), slots.columns)
    return found.withColumn("importance", F.round("importance", 9))


def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    slots, train, _ = _binned(spark, folder)
    return _nodes(_tree(slots, train))


def tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    slots, train, test = _binned(spark, folder)
    return _scored(slots, test, _tree(slots, train))


def regression_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One tree for a number: the discount in hundredths, by what else is known of a line."""
    slots, train, _ = _binned(spark, folder)
    target = train.withColumn("cents", F.round(F.col("l_discount") * 100).cast("long"))
    others = [i for i, c in enumerate(slots.columns) if c != "l_discount"]
    found = grow(target, slots.names, slots.by_level, "cents", None, 1, 2, MIN_LEAF, slots.max_bins, others).table()
    return found.select("tree", "node", "slot", "bin", F.round("gain", 6).alias("gain"), F.get("sums", F.lit(0)).alias("n"), F.get("sums", F.lit(1)).alias("total"))


QUERIES = {
    "forest_nodes": forest_nodes,
    "forest_scores": forest_scores,
    "forest_importances": forest_importances,
    "tree_nodes": tree_nodes,
    "tree_scores": tree_scores,
    "regression_tree_nodes": regression_nodes,
}

_SHARES = ", ".join(f"{i / 32!r}" for i in range(1, 32))
_CUTS = ",\n".join(f"list_sort(list_distinct(quantile_cont({c}, [{_SHARES}]))) as cuts_{c}" for c in NUMBERS)
_NUMBER_BINS = ", ".join(f"len(list_filter(cuts_{c}, lambda cut: cast({c} as double) > cut))" for c in NUMBERS)
_LEVEL = """
    places_{c} as (
        select {c}, row_number() over (order by count(*) desc, {c}) - 1 as place_{c}
        from train group by {c})"""
_BINNED = f"""
    with lines as (
        select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as line,
               case when l_returnflag = 'R' then 1 else 0 end as returned,
               {", ".join(NUMBERS)}, l_linestatus, 'm' || (l_suppkey % 3) as l_shipmode
        from lineitem),
    parts as (
        select *, ('0x' || substr(md5(line || ':42'), 1, 8))::bigint % 10 < 7 as is_train from lines),
    train as materialized (select * from parts where is_train),
    cuts as materialized (select {_CUTS} from train),
    {",".join(_LEVEL.format(c=c) for c in TEXTS)},
    binned as materialized (
        select line, returned, cast(round(l_discount * 100) as bigint) as cents, is_train,
               list_concat([{_NUMBER_BINS}], [{", ".join(f"least(coalesce(place_{c}, 31), 31)" for c in TEXTS)}]) as bins
        from parts cross join cuts {" ".join(f"left join places_{c} using ({c})" for c in TEXTS)})"""
_N_NUMBERS, _N_SLOTS = len(NUMBERS), len(NUMBERS) + len(TEXTS)
_PASSES = f"case when b.slot < {_N_NUMBERS} then s.bins[b.slot + 1] <= b.bin else s.bins[b.slot + 1] = b.bin end"


def _grown(trees: int, depth: int, per_node: int | None, seed: object = 0, bootstrap: bool = False, sums: str = "classes", without: int = -1) -> str:
    """CTEs up to ``nodes``: tree, node, slot, bin, gain, c0, c1."""
    byte = "('0x' || substr(md5(line || ':' || {seed} || ':0'), 2 * tree + 1, 2))::int".format(seed=seed)
    weight = " + ".join(f"({byte} >= {cut})::int" for cut in (94, 188, 235, 251, 255)) if bootstrap else "1"
    size = (lambda a: f"({a}0 + {a}1)") if sums == "classes" else (lambda a: f"{a}0")
    square = (lambda a: f"(1.0::double * {a}0 * {a}0 + 1.0::double * {a}1 * {a}1)") if sums == "classes" else (lambda a: f"(1.0::double * {a}1 * {a}1)")
    pure = lambda a: f"{square(a)} / greatest({size(a)}, 1)"
    value = ("w * (1 - returned)", "w * returned") if sums == "classes" else ("w", "w * cents")
    tried = f"where place <= {per_node}" if per_node else ""
    out = f"""{_BINNED},
    state0 as materialized (
        select * from (select tree, 1 as node, bins, returned, cents, {weight} as w
                       from binned, range({trees}) as t(tree) where is_train) where w > 0)"""
    for d in range(depth):
        out += f""",
    cells{d} as (
        select tree, node, slot, bins[slot + 1] as bin, cast(sum({value[0]}) as bigint) as o0, cast(sum({value[1]}) as bigint) as o1
        from state{d}, range({_N_SLOTS}) as t(slot) where slot <> {without} group by all),
    tried{d} as (
        select * from (
            select tree, node, slot, row_number() over (partition by tree, node order by md5('{seed}:' || tree || ':' || node || ':' || slot)) as place
            from (select distinct tree, node, slot from cells{d})) {tried}),
    sides{d} as (
        select tree, node, slot, bin,
               case when slot < {_N_NUMBERS} then sum(o0) over upto else o0 end as l0,
               case when slot < {_N_NUMBERS} then sum(o1) over upto else o1 end as l1,
               sum(o0) over whole as c0, sum(o1) over whole as c1
        from cells{d}
        window whole as (partition by tree, node, slot), upto as (partition by tree, node, slot order by bin)),
    gains{d} as (
        select *, case when {size("l")} >= {MIN_LEAF} and {size("r")} >= {MIN_LEAF}
                       then {pure("l")} + {pure("r")} - {pure("c")} else 0 end as gain
        from (select *, c0 - l0 as r0, c1 - l1 as r1 from sides{d}) join tried{d} using (tree, node, slot)),
    best{d} as materialized (
        select tree, node, cast(c0 as bigint) as c0, cast(c1 as bigint) as c1,
               case when gain > 1e-9 * {size("c")} then slot end as slot, case when gain > 1e-9 * {size("c")} then bin end as bin,
               case when gain > 1e-9 * {size("c")} then gain end as gain
        from gains{d} qualify row_number() over (partition by tree, node order by gain desc, slot, bin) = 1),
    state{d + 1} as materialized (
        select tree, 2 * node + case when {_PASSES} then 0 else 1 end as node, bins, returned, cents, w
        from state{d} s join best{d} b using (tree, node) where b.slot is not null)"""
    found = " union all ".join(f"select tree, node, slot, bin, gain, c0, c1 from best{d}" for d in range(depth))
    return f"""{out},
    nodes as materialized (
        {found} union all
        select tree, node, null, null, null, cast(sum({value[0]}) as bigint), cast(sum({value[1]}) as bigint) from state{depth} group by tree, node)"""


_NODE_ROWS = """
    select cast(tree as integer) as tree, cast(node as integer) as node, cast(slot as integer) as slot,
           cast(bin as integer) as bin, round(gain, 6) as gain, c0 as {a}, c1 as {b} from nodes"""


def _routed(depth: int, trees: int) -> str:
    out = f", at0 as (select line, bins, tree, 1 as node from binned, range({trees}) as t(tree) where not is_train)"
    for d in range(depth):
        out += f""", at{d + 1} as (
        select line, bins, tree, case when b.slot is null then node else 2 * node + case when {_PASSES} then 0 else 1 end end as node
        from at{d} s join nodes b using (tree, node))"""
    return out + f"""
    select line, round(avg(c1 / (c0 + c1)), 9) as probability from at{depth} join nodes using (tree, node) group by line"""


_FOREST = _grown(TREES, DEPTH, PER_NODE, SEED, bootstrap=True)
_TREE = _grown(1, DEPTH, None)
_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate([*NUMBERS, *TEXTS]))

ORACLE = {
    "forest_nodes": _FOREST + _NODE_ROWS.format(a="n_0", b="n_1"),
    "forest_scores": _FOREST + _routed(DEPTH, TREES),
    "forest_importances": f"""{_FOREST},
    shares as (
        select tree, slot, sum(gain) / sum(sum(gain)) over (partition by tree) as share
        from nodes where slot is not null group by tree, slot)
    select cast(n.slot as integer) as slot, name,
           round(coalesce(sum(share), 0) / (select count(distinct tree) from shares), 9) as importance
    from (values {_NAMES}) n(slot, name) left join shares s using (slot) group by n.slot, name""",
    "tree_nodes": _TREE + _NODE_ROWS.format(a="n_0", b="n_1"),
    "tree_scores": _TREE + _routed(DEPTH, 1),
    "regression_tree_nodes": _grown(1, 2, None, sums="number", without=NUMBERS.index("l_discount")) + _NODE_ROWS.format(a="n", b="total"),
}
