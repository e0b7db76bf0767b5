"""Queries of dictionaries: components, codes, pages, tokens, index, lookups and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import lexicon as x
from loomgrid.operators import tokenmerge as tm
from loomgrid.sources import domain as d

from .ranks import with_global_index
from .registry import query

#: Texts of whole dictionaries are short; the components of the customer table are.
COMP = "slots AS (SELECT code, 0 AS pos, l1 AS text FROM paths UNION ALL SELECT code, 1, l2 FROM paths UNION ALL SELECT code, 2, l3 FROM paths UNION ALL SELECT code, 3, l4 FROM paths), firsts AS (SELECT text, min((code-1)*4 + pos) AS seen FROM slots GROUP BY text), comps AS (SELECT row_number() OVER (ORDER BY seen) - 1 AS ord, text FROM firsts), codes AS (SELECT row_number() OVER (ORDER BY length(text), ord) - 1 AS text_code, text, length(text)::BIGINT AS n_tokens FROM comps)"
TOK = f"{COMP}, toks AS (SELECT text_code, p::BIGINT AS pos, substr(text, p::BIGINT + 1, 1) AS token FROM (SELECT text_code, text, unnest(generate_series(0, n_tokens - 1)) AS p FROM codes WHERE n_tokens > 0) a)"
IDS = f"{TOK}, ids AS (SELECT row_number() OVER (ORDER BY strlen(token), n DESC, token) - 1 AS token_id, token, n FROM (SELECT token, count(*) AS n FROM toks GROUP BY token) a)"
BIG = f"{TOK}, nxt AS (SELECT text_code, pos, token AS left_, lead(token) OVER (PARTITION BY text_code ORDER BY pos) AS right_ FROM toks), big AS (SELECT left_, right_, count(*) AS n, min(text_code*100000 + pos) AS f FROM nxt WHERE right_ IS NOT NULL GROUP BY left_, right_)"


def codes(spark, sf):
    return x.text_codes(x.components(d.paths(spark, sf)))


def toks(spark, sf):
    return x.tokens(codes(spark, sf))


@query("lex_paths", "paths", "SELECT code, code - 1 AS idx, l1, l2, l3, l4 FROM paths")
def lex_paths(spark, sf):
    return d.paths(spark, sf).select("code", (F.col("code") - 1).alias("idx"), *x.LEVELS)


@query("lex_tree_paths", "paths", "SELECT n, l1, l2, l3 FROM (SELECT l1, l2, l3, row_number() OVER (ORDER BY a, b, c) - 1 AS n FROM (SELECT l1, l2, l3, min(code) AS c, min(min(code)) OVER (PARTITION BY l1, l2) AS b, min(min(code)) OVER (PARTITION BY l1) AS a FROM paths GROUP BY l1, l2, l3) s) t")
def lex_tree_paths(spark, sf):
    """The tree of the paths' upper levels, a row a node, walked from its roots, and its leaves numbered depth first."""
    walked = x.walk_tree(x.tree_nodes(d.paths(spark, sf), x.LEVELS[:3])).where("leaf")
    return with_global_index(walked, ["path"], "n").select("n", *[F.get("parts", i).alias(f"l{i + 1}") for i in range(3)])


@query("lex_components", "paths", f"WITH {COMP} SELECT ord, text FROM comps")
def lex_components(spark, sf):
    return x.components(d.paths(spark, sf))


@query("lex_codes", "paths", f"WITH {COMP} SELECT text_code, text, n_tokens FROM codes")
def lex_codes(spark, sf):
    return codes(spark, sf)


@query("lex_component_read", "paths", f"WITH {COMP} SELECT text_code, text FROM codes WHERE text_code IN (0, 7, 20)")
def lex_component_read(spark, sf):
    return codes(spark, sf).where("text_code IN (0, 7, 20)").select("text_code", "text")


@query("lex_pages", "paths", f"WITH {COMP} SELECT text_code, n_tokens, ((k-1)//128)::BIGINT AS page, (k-1) % 128 AS slot FROM (SELECT text_code, n_tokens, row_number() OVER (PARTITION BY n_tokens ORDER BY text_code) AS k FROM codes) a")
def lex_pages(spark, sf):
    return x.pages(codes(spark, sf))


@query("lex_page_counts", "paths", f"WITH {COMP} SELECT n_tokens, count(*) AS records, ceil(count(*)/128.0)::BIGINT AS pages FROM codes GROUP BY n_tokens")
def lex_page_counts(spark, sf):
    g = codes(spark, sf).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("records"))
    return g.withColumn("pages", F.expr("(records + 127) div 128"))


@query("lex_tokens", "paths", f"WITH {IDS} SELECT token_id, token, n FROM ids")
def lex_tokens(spark, sf):
    return x.token_ids(toks(spark, sf))


@query("lex_token_frequency", "paths", f"WITH {TOK} SELECT token, count(*) AS n FROM toks GROUP BY token")
def lex_token_frequency(spark, sf):
    return toks(spark, sf).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("lex_bigrams", "paths", f"WITH {BIG} SELECT left_ AS \"left\", right_ AS \"right\", n, f//100000 AS first_code, f % 100000 AS first_pos FROM big")
def lex_bigrams(spark, sf):
    return x.bigrams(toks(spark, sf))


@query("lex_topk", "paths", f"WITH {BIG} SELECT left_ AS \"left\", right_ AS \"right\", n FROM big ORDER BY n DESC, f LIMIT 64")
def lex_topk(spark, sf):
    return x.top_bigrams(x.bigrams(toks(spark, sf))).select("left", "right", "n")


GAIN = "n*4 - (1 + strlen(left_ || right_))*8"


@query("lex_best", "paths", f"WITH {BIG} SELECT left_ AS \"left\", right_ AS \"right\", n, ({GAIN})::BIGINT AS gain FROM (SELECT * FROM big ORDER BY n DESC, f LIMIT 64) t WHERE {GAIN} >= 1 ORDER BY gain DESC, n DESC, left_ DESC, right_ DESC LIMIT 1")
def lex_best(spark, sf):
    return tm.best_pair(tm.arrays_of(codes(spark, sf)))


@query("lex_merge1", "paths", f"WITH {BIG}, b AS (SELECT left_ || right_ AS m FROM (SELECT * FROM big ORDER BY n DESC, f LIMIT 64) t WHERE {GAIN} >= 1 ORDER BY {GAIN} DESC, n DESC, left_ DESC, right_ DESC LIMIT 1) SELECT text_code, (n_tokens - (length(text) - length(replace(text, m, '')))//2)::INTEGER AS n_tokens, text FROM codes, b")
def lex_merge1(spark, sf):
    """The best pair made one token everywhere; the texts stay what they were."""
    a = tm.arrays_of(codes(spark, sf)).join(F.broadcast(tm.best_pair(tm.arrays_of(codes(spark, sf)))))  # one row
    m = a.withColumn("tokens", x.merge_pair(F.col("tokens"), F.col("left"), F.col("right")))
    return m.select("text_code", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "").alias("text"))


@query("lex_bpe_report")
def lex_bpe_report(spark, sf):
    """Merges until no pair gains; each step's choice rests on the one before, so SQL has no such query. Tests hold it to a plain version."""
    return tm.optimize_tokens(codes(spark, sf), sizes=True)[1]


@query("lex_text_bytes", "paths", f"WITH {COMP} SELECT text_code, text FROM codes WHERE text <> ''")
def lex_text_bytes(spark, sf):
    t = toks(spark, sf)
    return x.token_texts(t, x.token_ids(t))


@query("lex_record_page", "paths", f"WITH {COMP}, p AS (SELECT text_code, text, n_tokens, (row_number() OVER (PARTITION BY n_tokens ORDER BY text_code) - 1) AS k FROM codes) SELECT text_code, text FROM p WHERE n_tokens = 18 AND k = 3")
def lex_record_page(spark, sf):
    """One record of one page, decoded."""
    c = codes(spark, sf)
    one = x.pages(c).where("n_tokens = 18 AND page = 0 AND slot = 3").select("text_code")
    t = x.tokens(c).join(one, "text_code", "left_semi")
    return x.token_texts(t, x.token_ids(x.tokens(c)))


@query("lex_containers", "paths", "WITH p AS (SELECT code-1 AS idx, l1, l2, l3, lag(l1) OVER w AS q1, lag(l2) OVER w AS q2, lag(l3) OVER w AS q3 FROM paths WINDOW w AS (ORDER BY code)), h AS (SELECT idx, 1 AS depth, l1 AS name FROM p WHERE q1 IS NULL OR l1 <> q1 UNION ALL SELECT idx, 2, l2 FROM p WHERE q1 IS NULL OR l1 <> q1 OR l2 <> q2 UNION ALL SELECT idx, 3, l3 FROM p WHERE q1 IS NULL OR l1 <> q1 OR l2 <> q2 OR l3 <> q3) SELECT depth, row_number() OVER (PARTITION BY depth ORDER BY idx) - 1 AS ord, name, idx AS first_idx, coalesce(lead(idx) OVER (PARTITION BY depth ORDER BY idx), (SELECT count(*) FROM paths)) - idx AS leaf_count FROM h")
def lex_containers(spark, sf):
    return x.containers(d.paths(spark, sf))


@query("lex_leaf_offsets", "paths", "WITH p AS (SELECT code-1 AS idx, l1, lag(l1) OVER (ORDER BY code) AS q1 FROM paths), h AS (SELECT idx, l1 FROM p WHERE q1 IS NULL OR l1 <> q1), c AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS ord, coalesce(lead(idx) OVER (ORDER BY idx), (SELECT count(*) FROM paths)) - idx AS leaf_count FROM h) SELECT ord, leaf_count, (sum(leaf_count) OVER (ORDER BY ord) - leaf_count)::BIGINT AS base FROM c")
def lex_leaf_offsets(spark, sf):
    from loomgrid.plans.ranks import running

    c = x.containers(d.paths(spark, sf)).where("depth = 1").select("ord", "leaf_count")
    return running(c, "ord", "leaf_count", "through").select("ord", "leaf_count", (F.col("through") - F.col("leaf_count")).alias("base"))


def requests(spark, sf):
    return d.code_requests(spark, sf).where("code > 0").select("seq", (F.col("code") - 1).alias("idx"))


@query("lex_index_walk", "code_requests paths", "SELECT r.seq, r.code - 1 AS idx, l1 AS d1, l2 AS d2, l3 AS d3, l4 AS leaf FROM code_requests r JOIN paths p ON p.code = r.code WHERE r.code > 0")
def lex_index_walk(spark, sf):
    p = d.paths(spark, sf)
    return x.index_walk(requests(spark, sf), x.containers(p), p)


@query("lex_lookup_batch", "code_requests paths", "SELECT r.seq, r.code, l1, l2, l3, l4 FROM code_requests r LEFT JOIN paths p ON p.code = r.code")
def lex_lookup_batch(spark, sf):
    return x.lookup(d.code_requests(spark, sf), d.paths(spark, sf))


@query("lex_lookup_one", "paths", "SELECT code, array_to_string([l1, l2, l3, l4], '|') AS path FROM paths WHERE code = 42")
def lex_lookup_one(spark, sf):
    return d.paths(spark, sf).where("code = 42").select("code", F.array_join(F.array(*x.LEVELS), "|").alias("path"))


@query("lex_requested", "code_requests", "SELECT DISTINCT code FROM code_requests WHERE code > 0")
def lex_requested(spark, sf):
    return d.code_requests(spark, sf).where("code > 0").select("code").distinct()


@query("lex_reassemble", "paths", "SELECT code, array_to_string([l1, l2, l3, l4], '|') AS path FROM paths")
def lex_reassemble(spark, sf):
    p = d.paths(spark, sf)
    return x.reassemble(p, x.text_codes(x.components(p))).select("code", F.array_join("parts", "|").alias("path"))


@query("lex_batches", "code_requests", "WITH r AS (SELECT seq, code AS idx, lag(code) OVER (ORDER BY seq) AS prev FROM code_requests), s AS (SELECT seq, idx, max(CASE WHEN prev IS NULL OR prev > idx THEN seq END) OVER (ORDER BY seq) AS run_start FROM r) SELECT seq, idx, run_start, ((seq - run_start)//256)::BIGINT AS part FROM s")
def lex_batches(spark, sf):
    return x.batches(d.code_requests(spark, sf).select("seq", F.col("code").alias("idx")))


RARE = f"{TOK}, t AS (SELECT k.text_code, k.token, c.n_tokens FROM toks k JOIN codes c USING (text_code)), freq AS (SELECT n_tokens, token, count(*) AS f FROM t GROUP BY n_tokens, token), sets AS (SELECT DISTINCT n_tokens, text_code, token FROM t)"


@query("lex_rare_score", "paths", f"WITH {TOK}, freq AS (SELECT token, count(*) AS f FROM toks GROUP BY token) SELECT text_code, round(sum(1.0::DOUBLE/f), 6) AS score FROM (SELECT DISTINCT text_code, token FROM toks) s JOIN freq USING (token) GROUP BY text_code")
def lex_rare_score(spark, sf):
    t = toks(spark, sf)
    f = t.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    return t.select("text_code", "token").distinct().join(f, "token").groupBy("text_code").agg(F.round(F.sum(F.lit(1.0) / F.col("f")), 6).alias("score"))


@query("lex_rare_order", "paths", f"WITH {RARE}, sc AS (SELECT n_tokens, text_code, min(f) AS rare, round(sum(1.0::DOUBLE/f), 9) AS score FROM sets JOIN freq USING (n_tokens, token) GROUP BY n_tokens, text_code) SELECT c.n_tokens, c.text_code, row_number() OVER (PARTITION BY c.n_tokens ORDER BY rare ASC NULLS LAST, score DESC, c.text_code) - 1 AS \"at\" FROM codes c LEFT JOIN sc USING (n_tokens, text_code)")
def lex_rare_order(spark, sf):
    c = codes(spark, sf)
    return x.rare_order(x.tokens(c), c).select("n_tokens", "text_code", "at")


@query(
    "lex_cluster_order",
    "paths",
    f"WITH {RARE}, s AS (SELECT n_tokens, text_code, list({{'f': f, 'token': token}} ORDER BY f, token) AS l, count(*) AS size FROM sets JOIN freq USING (n_tokens, token) GROUP BY n_tokens, text_code), m AS (SELECT n_tokens, l[1] AS rep, count(*) AS members FROM s GROUP BY n_tokens, l[1]) SELECT c.n_tokens, c.text_code, row_number() OVER (PARTITION BY c.n_tokens ORDER BY m.rep.f ASC NULLS LAST, m.members DESC, m.rep.token, l[1:6], s.size DESC, c.text_code) - 1 AS \"at\" FROM codes c LEFT JOIN s USING (n_tokens, text_code) LEFT JOIN m ON m.n_tokens = s.n_tokens AND m.rep = s.l[1]",
)
def lex_cluster_order(spark, sf):
    c = codes(spark, sf)
    return x.cluster_order(x.tokens(c), c)


def records(spark, sf):
    c = codes(spark, sf)
    t = x.tokens(c)
    arrays = t.join(x.token_ids(t).select("token", "token_id"), "token").groupBy("text_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("ids"))
    return x.pages(c).join(arrays, "text_code").select("n_tokens", "page", "slot", "ids")


#: A page's stream: record by record, each with a mark at its end. A token that has no slot takes that of the token needed furthest from there.
PALETTES = f"""{IDS}, pg AS (SELECT text_code, n_tokens, (k // 128)::BIGINT AS page, k % 128 AS slot FROM (SELECT text_code, n_tokens, row_number() OVER (PARTITION BY n_tokens ORDER BY text_code) - 1 AS k FROM codes WHERE n_tokens > 0) a),
sq AS (SELECT pg.n_tokens, page, slot * (pg.n_tokens + 1) + pos AS i, token_id AS t FROM pg JOIN toks USING (text_code) JOIN ids USING (token)),
sx AS MATERIALIZED (SELECT *, lead(i) OVER (PARTITION BY n_tokens, page, t ORDER BY i) AS nx, row_number() OVER (PARTITION BY n_tokens, page ORDER BY i) AS k FROM sq),
fs AS (SELECT n_tokens, page, t, min(i) AS i FROM sq GROUP BY ALL),
fr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n_tokens, page ORDER BY i) AS s FROM fs),
sl AS (SELECT n_tokens, page, 0::BIGINT AS k, list({{'t': t, 'nx': i}} ORDER BY s) AS held, NULL::BIGINT AS w, NULL::BIGINT AS wt, NULL::BIGINT AS ws FROM fr WHERE s <= 15 GROUP BY n_tokens, page
UNION ALL SELECT n_tokens, page, k, CASE WHEN hit IS NULL THEN list_transform(held, lambda x, j: CASE WHEN j = gone THEN {{'t': t, 'nx': nx}} ELSE x END) ELSE list_transform(held, lambda x, j: CASE WHEN j = hit THEN {{'t': t, 'nx': nx}} ELSE x END) END, CASE WHEN hit IS NULL THEN i END, CASE WHEN hit IS NULL THEN t END, CASE WHEN hit IS NULL THEN gone END FROM (
SELECT sl.n_tokens, sl.page, sx.k, sl.held, sx.i, sx.t, sx.nx, list_position(list_transform(sl.held, lambda x: x.t), sx.t) AS hit, list_position(list_transform(sl.held, lambda x: [coalesce(x.nx, 1000000000000), x.t]), list_max(list_transform(sl.held, lambda x: [coalesce(x.nx, 1000000000000), x.t]))) AS gone FROM sl JOIN sx ON sx.n_tokens = sl.n_tokens AND sx.page = sl.page AND sx.k = sl.k + 1) z),
wr AS (SELECT n_tokens, page, -1::BIGINT AS position, t AS token_id, s AS slot FROM fr WHERE s <= 15 UNION ALL SELECT n_tokens, page, w, wt, ws FROM sl WHERE w IS NOT NULL)"""


@query("lex_palettes", "paths", f"WITH RECURSIVE {PALETTES} SELECT n_tokens, page, position, token_id, slot::BIGINT AS slot FROM wr")
def lex_palettes(spark, sf):
    """Slot writes of every page; sequential by nature."""
    return tm.page_palettes(records(spark, sf))


@query("lex_token_table_size", "paths", f"WITH {IDS}, g AS (SELECT strlen(token) AS s, count(*) AS n FROM ids GROUP BY 1), v AS (SELECT 1 + 1 + CASE WHEN n < 252 THEN 1 ELSE 2 END + CASE WHEN s*n < 252 THEN 1 WHEN s*n < 508 THEN 2 ELSE 3 END + s*n AS b, n FROM g) SELECT (sum(b) + CASE WHEN sum(n) < 252 THEN 1 WHEN sum(n) < 508 THEN 2 ELSE 3 END + 1)::BIGINT AS bytes, length(bin(sum(n)::BIGINT - 1))::BIGINT AS token_bits FROM v")
def lex_token_table_size(spark, sf):
    return tm.token_table_size(x.token_ids(toks(spark, sf)))


SIZE_OF = "CASE WHEN v < 252 THEN 1 WHEN v < 508 THEN 2 WHEN v < 66044 THEN 3 WHEN v < 16843260 THEN 4 ELSE 5 END"
STREAM = f"""{PALETTES}, bt AS (SELECT CASE WHEN count(*) <= 1 THEN 1 ELSE length(bin(count(*) - 1)) END AS b FROM ids),
ln AS (SELECT n_tokens, page, count(*) * (n_tokens + 1) AS n FROM pg GROUP BY n_tokens, page),
wo AS (SELECT n_tokens, page, position, lag(position, 1, 0) OVER (PARTITION BY n_tokens, page ORDER BY position) AS last FROM wr WHERE position >= 0),
pk AS (SELECT n_tokens, page, 15 + count(*) * b AS v FROM wr, bt WHERE position < 0 GROUP BY n_tokens, page, b
UNION ALL SELECT n_tokens, page, (position - last) * 4 FROM wo WHERE position > last UNION ALL SELECT n_tokens, page, 4 + b FROM wo, bt
UNION ALL SELECT n_tokens, page, (n - coalesce(m, 0)) * 4 FROM ln LEFT JOIN (SELECT n_tokens, page, max(position) AS m FROM wo GROUP BY n_tokens, page) x USING (n_tokens, page) WHERE n > coalesce(m, 0)),
sz AS (SELECT n_tokens, page, sum(2 + ({SIZE_OF}) * 8 + v) AS total, count(*) AS v FROM pk GROUP BY n_tokens, page)"""


@query("lex_stream_size", "paths", f"WITH RECURSIVE {STREAM} SELECT n_tokens::BIGINT AS n_tokens, page::BIGINT AS page, (({SIZE_OF}) * 8 + total + 7)::BIGINT // 8 AS bytes FROM sz")
def lex_stream_size(spark, sf):
    """Bytes of each page's record stream."""
    return tm.stream_bits(records(spark, sf), x.token_ids(toks(spark, sf)))
