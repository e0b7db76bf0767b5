"""Place-name dictionaries: fixed-depth paths, their components, tokens, index and lookups, as DataFrames.

paths: code (from 1), l1..lN. An absent level is '', never null. index = code - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.plans.checked import write_checked
from loomgrid.plans.ranks import running, with_global_index, within_groups
from loomgrid.plans.tables import materialize

PAGE = 128
LEVELS = ("l1", "l2", "l3", "l4")


def components(paths: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(ord, text): distinct components in order of first appearance, row by row."""
    n = len(levels)
    parts = paths.select(F.posexplode(F.array(*levels)).alias("pos", "text"), "code")
    first = parts.groupBy("text").agg(F.min((F.col("code") - 1) * n + F.col("pos")).alias("at"))
    return with_global_index(first, ["at"], "ord").select("ord", "text")


def text_codes(comps: DataFrame) -> DataFrame:
    """(text_code, text, n_tokens): codes by number of character tokens, then order of appearance."""
    t = comps.withColumn("n_tokens", F.length("text").cast("bigint"))
    return with_global_index(t, ["n_tokens", "ord"], "text_code").select("text_code", "text", "n_tokens")


def pages(codes: DataFrame, page_size: int = PAGE) -> DataFrame:
    """codes with page (from 0, within its token count) and slot."""
    firsts = codes.groupBy("n_tokens").agg(F.min("text_code").alias("first"))
    at = F.col("text_code") - F.col("first")  # codes of one token count are consecutive
    return codes.join(F.broadcast(firsts), "n_tokens").select("text_code", "n_tokens", F.expr(f"(text_code - first) div {page_size}").alias("page"), (at % page_size).alias("slot"))


def tokens(codes: DataFrame) -> DataFrame:
    """(text_code, pos, token): one token a character."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return codes.select("text_code", F.posexplode(chars).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def token_ids(toks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, token_id, token, n): ids by byte length, then falling frequency, then bytes; of each dictionary if by tells several apart."""
    c = toks.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.octet_length("token")).withColumn("less", -F.col("n"))
    order = ["size", "less", "token"]
    numbered = within_groups(c, list(by), order, "token_id") if by else with_global_index(c, order, "token_id")
    return numbered.select(*by, "token_id", "token", "n")


def bigrams(toks: DataFrame) -> DataFrame:
    """(left, right, n, first_code, first_pos): neighbouring tokens, counted, with where each pair comes first."""
    w = Window.partitionBy("text_code").orderBy("pos")
    pairs = toks.withColumn("right", F.lead("token").over(w)).where(F.col("right").isNotNull())
    g = pairs.groupBy(F.col("token").alias("left"), "right").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_code", "pos")).alias("f"))
    return g.select("left", "right", "n", F.col("f.text_code").alias("first_code"), F.col("f.pos").alias("first_pos"))


def top_bigrams(pairs: DataFrame, k: int = 64) -> DataFrame:
    return pairs.orderBy(F.desc("n"), "first_code", "first_pos").limit(k)


def merge_gain(n: Column, merged: Column) -> Column:
    """Bits won by a merged token: four an occurrence, less its place in the token table."""
    from loomgrid.functions.grid import varint_size

    size = F.octet_length(merged).cast("bigint")
    return n * 4 - (varint_size(size) + size) * 8


def merge_pair(array: Column, left: Column, right: Column) -> Column:
    """An array of tokens with each (left, right) made one, from the left, none used twice.

    Each token's part in the pair is one letter of a string, where a regular expression finds the pairs from the left:
    one pass for an array of any length.
    """
    part = F.transform(array, lambda t: F.when((t == left) & (t == right), "B").when(t == left, "L").when(t == right, "R").otherwise("."))
    marks = F.split(F.regexp_replace(F.array_join(part, ""), "LR|BB", "mx"), "")
    merged = F.zip_with(array, marks, lambda t, m: F.when(m == "m", F.concat(left, right)).when(m == "x", F.lit(None).cast("string")).otherwise(t))
    return F.filter(merged, lambda t: t.isNotNull())


def containers(paths: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(depth, ord, name, first_idx, leaf_count): runs of consecutive paths with an equal prefix, at each depth.

    A prefix that comes again later is another container. Neighbours meet by an equi-join on the index, so no task sees
    all paths in order.
    """
    p = paths.select((F.col("code") - 1).alias("idx"), *levels)
    prev = p.select((F.col("idx") + 1).alias("idx"), *[F.col(c).alias(f"p_{c}") for c in levels])
    j = p.join(prev, "idx", "left")
    changed, starts = F.lit(False), []
    for d, c in enumerate(levels[:-1], 1):
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"p_{c}")) | F.col(f"p_{c}").isNull()
        starts.append(F.when(changed, F.struct(F.lit(d).alias("depth"), F.col(c).alias("name"))))
    heads = j.select("idx", F.explode(F.filter(F.array(*starts), lambda s: s.isNotNull())).alias("s")).select(F.col("s.depth").alias("depth"), F.col("s.name").alias("name"), F.col("idx").alias("first_idx"))
    end = paths.agg(F.max("code").alias("end"))
    placed = within_groups(heads, ["depth"], ["first_idx"], "ord")
    after = placed.select("depth", (F.col("ord") - 1).alias("ord"), F.col("first_idx").alias("next"))
    out = placed.join(after, ["depth", "ord"], "left")
    # one row on the right
    return out.join(F.broadcast(end)).select("depth", "ord", "name", "first_idx", (F.coalesce("next", "end") - F.col("first_idx")).alias("leaf_count"))


def index_walk(requests: DataFrame, conts: DataFrame, paths: DataFrame, block: int = 1024) -> DataFrame:
    """(seq, idx, d1..d3, leaf): the container of each depth that holds an index, and the leaf's own name.

    Containers are laid over the leaves, by an equi-join on blocks of the index that a container touches, so a request
    meets one row however many containers hold it.
    """
    leaves = paths.select((F.col("code") - 1).alias("idx"), F.col("l4").alias("leaf")).withColumn("blk", F.expr(f"idx div {block}"))
    spread = conts.withColumn("blk", F.explode(F.sequence(F.floor(F.col("first_idx") / block), F.floor((F.col("first_idx") + F.col("leaf_count") - 1) / block))))
    j = leaves.join(spread, "blk").where((F.col("idx") >= F.col("first_idx")) & (F.col("idx") < F.col("first_idx") + F.col("leaf_count")))
    g = j.groupBy("idx").agg(*[F.max(F.when(F.col("depth") == d, F.col("name"))).alias(f"d{d}") for d in (1, 2, 3)], F.first("leaf").alias("leaf"))
    return requests.where(F.col("idx") >= 0).join(g, "idx").select("seq", "idx", "d1", "d2", "d3", "leaf")


def lookup(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """(seq, code, l1..l4) for every request, in place; no path for codes of 0 or less or unknown ones. Order by seq at the edge."""
    return requests.join(paths, "code", "left").select("seq", "code", *LEVELS)


def batches(requests: DataFrame, size: int = 256) -> DataFrame:
    """(seq, idx, run_start, part): maximal runs of non-decreasing index along seq (from 1, no gaps), cut at size."""
    prev = requests.select((F.col("seq") + 1).alias("seq"), F.col("idx").alias("prev"))
    j = requests.join(prev, "seq", "left").withColumn("head", F.when(F.col("prev").isNull() | (F.col("prev") > F.col("idx")), F.col("seq")))
    r = running(j, "seq", "head", "run_start", "max")
    return r.select("seq", "idx", "run_start", F.expr(f"(seq - run_start) div {size}").alias("part"))


def reassemble(paths: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, parts): each path put together from its components' text codes, in slot order."""
    slots = paths.select("code", F.posexplode(F.array(*LEVELS)).alias("pos", "text"))
    coded = slots.join(codes.select("text_code", "text"), "text").select("code", "pos", "text_code")
    back = coded.join(codes.select("text_code", "text"), "text_code")
    return back.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("parts"))


def token_texts(toks: DataFrame, ids: DataFrame) -> DataFrame:
    """(text_code, text): token ids back to text."""
    j = toks.join(ids.select("token_id", "token"), "token").select("text_code", "pos", "token_id").join(ids.select("token_id", F.col("token").alias("t")), "token_id")
    return j.groupBy("text_code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "").alias("text"))


def rare_order(toks: DataFrame, codes: DataFrame) -> DataFrame:
    """(n_tokens, text_code, at): texts of a token count by their rarest token's frequency, then falling rarity, then code."""
    each = toks.select("text_code", "token").distinct().join(codes.select("text_code", "n_tokens"), "text_code")
    freq = toks.join(codes.select("text_code", "n_tokens"), "text_code").groupBy("n_tokens", "token").agg(F.count(F.lit(1)).alias("f"))
    score = each.join(freq, ["n_tokens", "token"]).groupBy("n_tokens", "text_code").agg(F.min("f").alias("rare"), F.round(F.sum(F.lit(1.0) / F.col("f")), 9).alias("score"))
    all_texts = codes.select("text_code", "n_tokens").join(score, ["n_tokens", "text_code"], "left")
    order = [F.col("rare").asc_nulls_last(), F.col("score").desc(), F.col("text_code")]
    return within_groups(all_texts.select("n_tokens", "text_code", "rare", "score"), ["n_tokens"], order, "at")


def cluster_order(toks: DataFrame, codes: DataFrame) -> DataFrame:
    """(n_tokens, text_code, at): texts of a token count clustered by their rarest token."""
    t = toks.join(codes.select("text_code", "n_tokens"), "text_code")
    freq = t.groupBy("n_tokens", "token").agg(F.count(F.lit(1)).alias("f"))
    sets = t.select("n_tokens", "text_code", "token").distinct().join(freq, ["n_tokens", "token"]).groupBy("n_tokens", "text_code").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
    s = sets.select("n_tokens", "text_code", F.get("s", 0).alias("rep"), F.slice("s", 1, 6).alias("rarest"), F.size("s").alias("size"))
    size = s.groupBy("n_tokens", "rep").agg(F.count(F.lit(1)).alias("members"))
    j = codes.select("text_code", "n_tokens").join(s.join(size, ["n_tokens", "rep"]), ["n_tokens", "text_code"], "left")
    order = [F.col("rep.f").asc_nulls_last(), F.desc("members"), F.col("rep.token"), F.col("rarest"), F.desc("size"), F.col("text_code")]
    return within_groups(j, ["n_tokens"], order, "at").select("n_tokens", "text_code", "at")


def tree_nodes(paths: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(id, parent, position, name) of the trees that paths spell out: a node for each distinct prefix.

    A node's id is its depth and the least code below it, its position that code; roots have no parent.
    """
    depth_of = 1 << 48
    nodes = None
    for d in range(1, len(levels) + 1):
        prefix = list(levels[:d])
        own = paths.groupBy(*prefix).agg(F.min("code").alias("position"))
        if d == 1:
            own = own.withColumn("above", F.lit(None).cast("bigint"))
        else:
            above = paths.groupBy(*prefix[:-1]).agg(F.min("code").alias("above"))
            own = own.join(above, prefix[:-1])
        own = own.select((F.lit(d * depth_of) + F.col("position")).alias("id"), (F.lit((d - 1) * depth_of) + F.col("above")).alias("parent"), "position", F.col(levels[d - 1]).alias("name"))
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes


def walk_tree(nodes: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, path, parts, leaf) of nodes (id, parent, position, name): positions and names from the root down to each.

    path sorts nodes depth first. Each level is a join of the nodes with the level above, so a tree of any shape is walked
    in as many steps as it is deep, and no tree is one row. A node that no root leads to (a missing parent or a circle)
    is an error, as is a tree deeper than max_depth.
    """
    nodes = materialize(nodes.select("id", "parent", "position", "name"), "nodes")
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    level = materialize(nodes.where("parent is null").select("id", F.array("position").alias("path"), F.array("name").alias("parts")), "level")
    walked, seen = level, level.count()
    for _ in range(max_depth):
        above = level.select(F.col("id").alias("parent"), "path", "parts")
        level = materialize(nodes.join(above, "parent").select("id", F.concat("path", F.array("position")).alias("path"), F.concat("parts", F.array("name")).alias("parts")), "level")
        n = level.count()
        if not n:
            break
        walked, seen = walked.unionByName(level), seen + n
    else:
        raise ValueError("a tree is deeper than max_depth")
    if seen != nodes.count():
        raise ValueError("nodes without a way to a root")
    return walked.join(parents.withColumn("leaf", F.lit(False)), "id", "left").select("id", "path", "parts", F.coalesce("leaf", F.lit(True)).alias("leaf"))


def tree_paths(trees: DataFrame, depth: int) -> DataFrame:
    """(tree_id, path, parts) of [name, [children]] trees in column json, depth first; '' fills no level: a branch that ends early is an error.

    Levels are unrolled: depth is a property of the format, so the plan is fixed.
    """
    cur = trees.select("tree_id", F.parse_json("json").alias("v"), F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("parts"))
    for _ in range(depth):
        kids = cur.lateralJoin(cur.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select("tree_id", "path", "parts", "pos", F.col("value").alias("node"))
        name = F.try_variant_get("node", F.lit("$[0]"), "string")
        ok = F.when(name.isNotNull(), name).otherwise(F.raise_error(F.lit("a branch ends above the tree's depth")))
        cur = kids.select("tree_id", F.try_variant_get("node", F.lit("$[1]"), "variant").alias("v"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"), F.concat("parts", F.array(ok)).alias("parts"))
    return cur.select("tree_id", "path", "parts")


def coded_slots(paths: DataFrame, codes: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(code, pos, text_code) of every slot; text_code is null where no text of codes is the slot's."""
    slots = paths.select("code", F.posexplode(F.array(*levels)).alias("pos", "text"))
    return slots.join(codes.select("text", "text_code"), "text", "left").select("code", "pos", "text_code")


def stored_slots(paths: DataFrame, codes: DataFrame, path: str, levels: Sequence[str] = LEVELS) -> dict[str, int]:
    """Writes coded_slots() and returns its counts, which must hold: each slot has a text (once), each code fits the width of the texts' number, and paths are numbered from 1 without a gap.

    The counts are made by the write itself. What breaks a relation leaves no table, and is an error.
    """
    texts = codes.count()
    kept = {
        "slots": (F.count(F.lit(1)), None),
        "records": (F.count_if(F.col("pos") == 0), None),
        "last": (F.coalesce(F.max("code"), F.lit(0)), "records"),
        "first": (F.coalesce(F.min("code"), F.lit(1)), 1),
        "missing": (F.count_if(F.col("text_code").isNull()), 0),
        "beyond": (F.count_if((F.col("text_code") >= texts) | (F.col("text_code") < 0)), 0),
        "code_sum": (F.coalesce(F.sum(F.when(F.col("pos") == 0, F.col("code"))), F.lit(0)), "triangle"),
    }
    found = write_checked(coded_slots(paths, codes, levels), path, kept, lambda m: {"triangle": m["records"] * (m["records"] + 1) // 2, "slots": m["records"] * len(levels)})
    return found | {"texts": texts}
