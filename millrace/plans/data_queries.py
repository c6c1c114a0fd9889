"""Queries on ontologies, corpora, vectors, boxes and QA records, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..functions import vectors as V
from ..operators import components as C
from ..operators import corpus, geometry, grouping, ontology, similarity
from .fixtures import BOXES, CAPTIONS, LINES, ONTOLOGY, STOPWORDS, boxes, captions, lines, local, ontology_rows, sql_list, table, values
from .text_queries import _U

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- ontology

_ONT = f"(SELECT * FROM (VALUES {values(ontology_rows())}) t(category, word, ord))"
_WORDS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"
_TOK = f"(SELECT idx, unnest({_WORDS.format(t='txt')}) AS w FROM {CAPTIONS})"
_LOOK = "(SELECT category FROM {ont} o WHERE o.word = {w})"


def _ont(spark):
    return local(spark, ontology_rows(), "category, word, ord")


def _ont_map():
    return F.map_from_arrays(T.strs(*(w for _, w, _ in ontology_rows())), T.strs(*(c for c, _, _ in ontology_rows())))


@query(f"""
    WITH o AS {_ONT}, t AS (SELECT DISTINCT w FROM {_TOK}),
    k AS (SELECT w, unnest([w, w || 's', w || 'es', CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] END, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-3] END]) AS v, unnest(range(5)) AS r FROM t),
    m AS (SELECT w, min_by(category, r) AS category FROM k JOIN o ON o.word = k.v GROUP BY w)
    SELECT idx, array_to_string(list(coalesce(category, x.w) ORDER BY pos), ' ') AS txt
    FROM (SELECT idx, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT idx, {_WORDS.format(t='txt')} AS ws FROM {CAPTIONS})) x LEFT JOIN m ON m.w = x.w GROUP BY idx""")
def ontology_map_tokens(spark, sf_dir):
    w = F.transform(T.words(F.col("txt")), lambda x: F.coalesce(ontology.lookup(x, _ont_map()), x))
    return captions(spark, sf_dir).select("idx", F.array_join(w, " ").alias("txt"))


@query(f"""
    WITH o AS {_ONT}, t AS (SELECT DISTINCT idx, w FROM {_TOK}), p AS (SELECT a.w AS word, o.category FROM t a JOIN t b USING (idx) JOIN o ON o.word = b.w),
    n AS (SELECT word, category, count(*) AS n FROM p GROUP BY ALL)
    SELECT word, category, n, round(n / s, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS s FROM n) WHERE n >= 4 AND n / s >= 0.2""")
def ontology_counts(spark, sf_dir):
    d = captions(spark, sf_dir).select("idx", F.array_distinct(T.words(F.col("txt"))).alias("ws"))
    d = d.select(F.col("ws"), F.explode("ws").alias("b")).join(_ont(spark), F.col("b") == F.col("word")).select(F.explode("ws").alias("word"), "category")
    return ontology.conditional_share(d, 4, 0.2).select("word", "category", "n", F.round("share", 6).alias("share"))


@query(f"SELECT word, n FROM (SELECT w AS word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS r, count(*) OVER () AS total FROM (SELECT unnest({_WORDS.format(t='text')}) AS w FROM documents) GROUP BY w) WHERE r <= floor(total * 0.02)")
def vocab_top_percent(spark, sf_dir):
    return ontology.top_share(table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")), 0.02)


@query(f"""
    WITH o AS {_ONT}, c AS (SELECT w, count(*) AS n FROM {_TOK} GROUP BY w)
    SELECT category, word, n FROM (SELECT category, word, coalesce(a.n, b.n, d.n, 0) AS n FROM o LEFT JOIN c a ON a.w = word LEFT JOIN c b ON b.w = word || 's' LEFT JOIN c d ON d.w = word || 'es') WHERE n >= 100""")
def ontology_trim(spark, sf_dir):
    counts = captions(spark, sf_dir).select(F.explode(T.words(F.col("txt"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return ontology.trim(_ont(spark).select("category", "word"), counts, 100)


@query(f"SELECT word, max_by(category, ord) AS category, min_by(category, ord) AS first_category FROM (SELECT * FROM {_ONT} UNION ALL VALUES ('toy', 'teddy bear', 900), ('toy', 'boat', 901)) GROUP BY word")
def ontology_invert(spark, sf_dir):
    rows = _ont(spark).unionByName(local(spark, [("toy", "teddy bear", 900), ("toy", "boat", 901)], "category, word, ord"))
    return ontology.invert(rows).join(ontology.invert(rows, last_wins=False).withColumnRenamed("category", "first_category"), "word")


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT lower(unnest({_WORDS.format(t='text')})) AS w FROM documents) WHERE length(w) > 2 AND NOT list_contains({sql_list(STOPWORDS)}, w) GROUP BY w HAVING count(*) >= 20")
def stopword_filter(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.lower("text"))).alias("word"))
    stop = local(spark, [(x,) for x in STOPWORDS], "word")
    return w.where(F.length("word") > 2).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").join(stop, "word", "left_anti")


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_WORDS.format(t='text')}) AS w FROM documents) WHERE NOT regexp_matches(w, '(ous|al|ed|ing|es|less|ful)$') GROUP BY w HAVING count(*) >= 20")
def suffix_filter(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 20) & ~F.col("word").rlike("(ous|al|ed|ing|es|less|ful)$"))


_P4 = "list_transform({l}, lambda x: left(lower(x), 4))"


@query(f"SELECT idx, len(list_intersect({_P4.format(l='ws')}, {_P4.format(l=sql_list(['catfish', 'Oakwood', 'pizzas', 'boa']))})) > 0 AS shares FROM (SELECT idx, {_WORDS.format(t='txt')} AS ws FROM {CAPTIONS})")
def prefix4_semi_join(spark, sf_dir):
    return captions(spark, sf_dir).select("idx", T.shares_prefix(T.words(F.col("txt")), T.strs("catfish", "Oakwood", "pizzas", "boa")).alias("shares"))


_EDGES = [("entity", "animal"), ("entity", "plant"), ("animal", "dog"), ("animal", "bird"), ("bird", "owl"), ("bird", "finch"), ("plant", "tree"), ("tree", "oak"), ("dog", "hound"), ("hound", "beagle"), ("animal", "owl")]


@query(f"""
    WITH RECURSIVE e AS (SELECT * FROM (VALUES {values(_EDGES)}) t(parent, child)), r(root, node) AS (SELECT 'animal', 'animal' UNION SELECT 'plant', 'plant' UNION SELECT r.root, e.child FROM r JOIN e ON e.parent = r.node)
    SELECT root, node FROM r WHERE node <> 'owl'""")
def hypernym_closure(spark, sf_dir):
    below = ontology.closure(local(spark, _EDGES, "parent, child"), local(spark, [("animal",), ("plant",)], "node"))
    return below.join(local(spark, [("owl",)], "node"), "node", "left_anti").select("root", "node")


# ---- corpus

@query("SELECT doc_id, min(text_md5) AS text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1 GROUP BY doc_id")
def md5_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return grouping.first_by(d, ["text_md5"], ["doc_id"])


@query("SELECT page_id, CASE WHEN starts_with(url, 'http') AND NOT contains(url, ',') THEN url ELSE '' END AS url, m FROM pages JOIN (SELECT url, max_by(md5(html), page_id) AS m FROM pages WHERE page_id % 7 <> 0 GROUP BY url) s USING (url)")
def sidecar_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    side = p.where("page_id % 7 <> 0").groupBy("url").agg(F.max_by(F.md5("html"), "page_id").alias("m"))
    return p.select("page_id", "url").join(side, "url").select("page_id", T.valid_url(F.col("url")).alias("url"), "m")


@query("SELECT page_id, concat_ws('_', (page_id // 100) * 100, (page_id // 100) * 100 + 99) AS shard FROM pages WHERE page_id BETWEEN 30 AND 180")
def shard_slice(spark, sf_dir):
    start = F.floor(F.col("page_id") / 100) * 100
    return table(spark, sf_dir, "pages").where(F.col("page_id").between(30, 180)).select("page_id", F.concat_ws("_", start.cast("string"), (start + 99).cast("string")).alias("shard"))


@query("SELECT page_id, string_split(string_split(f, '.')[1], '_')[-1]::INTEGER AS file_id FROM (SELECT page_id, printf('COCO_val_%012d.jpg', page_id) AS f FROM pages)")
def file_id_parse(spark, sf_dir):
    from ..sources.readers import file_id

    return table(spark, sf_dir, "pages").select("page_id", file_id(F.format_string("COCO_val_%012d.jpg", "page_id")).alias("file_id"))


_NUMBERED = f"(SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no FROM {LINES})"


@query(f"SELECT pos, line_no, line FROM (SELECT unnest([500, 3, 500, 77, 9]) AS line_no, unnest(range(5))::INTEGER AS pos) k JOIN (SELECT line_no, line FROM {_NUMBERED}) USING (line_no) UNION ALL SELECT -1, line_no, line FROM {_NUMBERED} WHERE line_no >= 100 AND line_no < 110")
def line_lookup(spark, sf_dir):
    return _looked_up(corpus.number_lines(lines(spark, sf_dir)).select("line_no", "line"))


def _looked_up(n):
    return corpus.lookup_list(n, [500, 3, 500, 77, 9]).unionByName(corpus.lookup_range(n, 100, 110).select(F.lit(-1).alias("pos"), "line_no", "line"))


@query(f"SELECT doc_id, pos::INTEGER AS pos, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM {LINES}")
def seekpoints(spark, sf_dir):
    return corpus.offsets(lines(spark, sf_dir), "doc_id", "pos", "line").select("doc_id", "pos", F.col("offset").cast("bigint").alias("offset"))


_N = f"(SELECT line_no, list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {_NUMBERED})"


@query(f"""
    WITH d AS (SELECT line_no, len(w) AS l, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'was')) AS b FROM {_N}),
    s AS (SELECT count(*) AS n, avg(l) AS av, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM d)
    SELECT line_no, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / av)), 6) AS score
    FROM d, s WHERE a > 0 AND b > 0 ORDER BY score DESC, line_no LIMIT 25""")
def bm25_search(spark, sf_dir):
    return corpus.bm25(corpus.number_lines(lines(spark, sf_dir)), "line_no", "line", ["that", "was"], 25)


@query(ORACLES["bm25_search"])
def index_search(spark, sf_dir):
    """The same search in a stored index of terms, of which only the wanted ones are read."""
    path = f"{C.shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    corpus.write_terms(corpus.number_lines(lines(spark, sf_dir)), "line_no", "line", path, 8)
    return corpus.search_terms(spark, path, ["that", "was"], 25).withColumnRenamed("key", "line_no")


@query(ORACLES["line_lookup"])
def index_lookup(spark, sf_dir):
    """The same lookup in stored lines, pruned by their numbers."""
    path = f"{C.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    corpus.write_index(corpus.number_lines(lines(spark, sf_dir)).select("line_no", "line"), path, 8)
    return _looked_up(spark.read.parquet(path))


@query("SELECT lower(regexp_extract(url, '^(https?)', 1)) IN ('http', 'https') AS remote, sha256(url) || '.' || sha256(page_id::VARCHAR) AS name, page_id FROM pages")
def cached_filename(spark, sf_dir):
    from ..sources.readers import cache_name, is_remote

    return table(spark, sf_dir, "pages").select(is_remote(F.col("url")).alias("remote"), cache_name(F.col("url"), F.col("page_id").cast("string")).alias("name"), "page_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, round(sum(value) OVER w, 2) AS sum100, round(avg(value) OVER w, 9) AS mean100, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def running_mean_100(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("sum100"), F.round(F.avg("value").over(w), 9).alias("mean100"), F.count(F.lit(1)).over(w).alias("n"))


@query(f"SELECT s AS draw, line_no, line FROM (SELECT s, floor({_U.format(key='s', step='line')} * (SELECT count(*) FROM {LINES}))::BIGINT AS line_no FROM range(200) t(s)) JOIN (SELECT line_no, line FROM {_NUMBERED}) USING (line_no)")
def random_lines(spark, sf_dir):
    from ..operators.sampling import draw_lines

    return draw_lines(corpus.number_lines(lines(spark, sf_dir)).select("line_no", "line"), 200)


_ATTR = ("", "", "", "", "", "", "", "", "red", "old", "shiny", "broken")


@query(f"SELECT p_partkey, trim(({sql_list(_ATTR)})[1 + floor({_U.format(key='p_partkey', step='attr')} * {len(_ATTR)})::INT] || ' ' || p_name) AS name FROM part")
def weighted_attribute(spark, sf_dir):
    from ..operators.sampling import weighted_choice

    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.concat(weighted_choice(F.col("p_partkey"), "attr", _ATTR), F.lit(" "), "p_name")).alias("name"))


@query("SELECT conv_id, turn, role, unnest(range(3))::INTEGER AS beam FROM conversations")
def beam_repeat(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("beam"))


@query(f"""
    WITH RECURSIVE r AS (SELECT page_id, string_split(url, '/')[3] AS h, left(regexp_extract(html, '<title>(.*?)</title>', 1), 4) AS t FROM pages),
    e AS (SELECT DISTINCT 'a:' || h AS x, 'b:' || t AS y FROM r), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    c(node, root) AS (SELECT x, x FROM b UNION SELECT b.y, c.root FROM c JOIN b ON b.x = c.node)
    SELECT page_id, root AS component FROM r JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) ON node = 'a:' || h""")
def components_merge(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("h"), F.left(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(4)).alias("t"))
    return C.merge_groups(p, "h", "t").select("page_id", "component")


# ---- vectors

_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_S = f"(SELECT t.label, t.vec_id AS text, i.vec_id AS image, list_cosine_similarity(t.v, i.v) AS score FROM {_E} t JOIN {_E} i ON t.label = i.label AND t.vec_id % 2 = 0 AND i.vec_id % 2 = 1)"


def _sides(spark, sf_dir):
    """Texts, images and what they share; embeddings with an even number stand for texts."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.unit(V.as_double(F.col("embedding"))).alias("u"))
    t = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("text"), F.col("u").alias("text_u"))
    i = e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("image"), F.col("u").alias("image_u"))
    return t, i, ["label"]


@query(f"SELECT text, image, round(score, 6) AS score FROM {_S}")
def cosine_matrix(spark, sf_dir):
    return similarity.score_within(*_sides(spark, sf_dir), lambda s: similarity.rounded(s, 6)).select("text", "image", "score")


@query(f"SELECT text, image, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, image) AS rank FROM {_S}) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return similarity.top_k(similarity.top_within(*_sides(spark, sf_dir), 5, 9), 5).select("text", "image", "rank")


@query(f"SELECT text, max_by(image, (round(score, 9), image)) AS image, round(max(score), 6) AS score FROM {_S} GROUP BY text HAVING max(score) >= 0.21")
def best_match_cutoff(spark, sf_dir):
    return similarity.best_within(*_sides(spark, sf_dir), 9).where("score >= 0.21").withColumn("score", F.round("score", 6))


@query(f"SELECT text, image, round(score * least(1.0, score + 0.65), 6) AS weighted FROM {_S}")
def box_weighted_score(spark, sf_dir):
    weighted = lambda s: similarity.rounded(similarity.box_weighted(s), 6)
    return similarity.score_within(*_sides(spark, sf_dir), weighted).select("text", "image", F.col("score").alias("weighted"))


@query(f"""
    WITH RECURSIVE c AS (SELECT label, text, image, round(score, 9) AS score, row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, image) AS r FROM {_S}),
    t AS (SELECT label, text, list(image ORDER BY r) AS cs, max(score) AS top FROM c WHERE r <= 5 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY top DESC, text) AS k FROM t),
    run(label, k, text, pick, used) AS (
        SELECT label, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT label FROM o)
        UNION ALL
        SELECT o.label, o.k, o.text, list_filter(o.cs, lambda x: NOT list_contains(run.used, x))[1], list_append(run.used, list_filter(o.cs, lambda x: NOT list_contains(run.used, x))[1]) FROM run JOIN o ON o.label = run.label AND o.k = run.k + 1)
    SELECT label, text, pick AS image FROM run WHERE pick IS NOT NULL""")
def greedy_assignment(spark, sf_dir):
    return similarity.assign_greedily(similarity.top_within(*_sides(spark, sf_dir), 5, 9), "label", 5).select("label", "text", "image")


@query(f"SELECT text, bool_or(image % 5 = 1 AND score >= 0.21 * 1.2) AS vetoed, NOT bool_or(score >= 0.21) AS undrawable, len(list(image) FILTER (WHERE NOT (image % 5 = 1) AND (image % 3 <> 0 OR score >= 0.21 * 1.2))) AS kept FROM {_S} GROUP BY text")
def distractor_veto(spark, sf_dir):
    def counted(images, scores):
        n, known = images.to_numpy(), scores > -np.inf
        high, distractor = scores >= 0.21 * 1.2, np.fmod(n, 5) == 1
        kept = ~distractor & ((np.fmod(n, 3) != 0) | high)
        found = {"vetoes": distractor & high, "sure": ~distractor | known, "drawable": scores >= 0.21, "known": known, "kept": kept}
        return {c: np.count_nonzero(x, axis=1) for c, x in found.items()}

    t = similarity.tally_within(*_sides(spark, sf_dir), counted, ("vetoes", "sure", "drawable", "known", "kept"))
    return t.select("text", F.when(F.col("sure") > 0, F.col("vetoes") > 0).alias("vetoed"), F.when(F.col("known") > 0, F.col("drawable") == 0).alias("undrawable"), "kept")


@query("SELECT vec_id, round(list_max(p), 6) AS top, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS cls FROM (SELECT vec_id, embedding, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings))")
def softmax_argmax(spark, sf_dir):
    v = V.as_double(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(V.softmax(v)), 6).alias("top"), V.argmax(v).alias("cls"))


@query("SELECT a.vec_id, round(len(list_filter(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) > 0.1 + 0.01 * abs(b.embedding[i]::DOUBLE))) / 64.0, 6) AS share FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def tolerance_share(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    d = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    off = F.filter(F.zip_with("v", "w", lambda a, b: F.abs(a - b) > 0.1 + 0.01 * F.abs(b)), lambda x: x)
    return d.select("vec_id", F.round(F.size(off) / 64.0, 6).alias("share"))


# ---- boxes

_XY = ("x1", "y1", "x2", "y2")
_IOU = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1){p}) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1){p})"


def _iou_sql(a: str, b: str, p: str = "") -> str:
    i = _IOU.format(a=a, b=b, p=p)
    area = lambda x: f"({x}.x2 - {x}.x1{p}) * ({x}.y2 - {x}.y1{p})"
    return f"({i}) / ({area(a)} + {area(b)} - ({i}))"


_cols = lambda p="": [F.col(f"{p}{c}") for c in _XY]


def _paired(spark, sf_dir):
    b = boxes(spark, sf_dir)
    other = b.select("img", F.col("box").alias("box2"), *(F.col(c).alias(f"o_{c}") for c in _XY))
    return b.join(other, "img")


@query(f"SELECT a.img, a.box, b.box AS box2, round({_iou_sql('a', 'b', ' + 1')}, 6) AS iou FROM {BOXES} a JOIN {BOXES} b ON a.img = b.img AND a.box < b.box")
def iou_pairs(spark, sf_dir):
    return _paired(spark, sf_dir).where("box < box2").select("img", "box", "box2", F.round(B.iou(_cols(), _cols("o_"), 1.0), 6).alias("iou"))


_FOLD = f"list_reduce(list_concat([[]::STRUCT(box BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]], list_transform(bs, lambda b: [b])), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {_iou_sql('k', 'x[1]')} > 0.5)) > 0 THEN kept ELSE list_concat(kept, x) END)"


@query(f"SELECT img, unnest({_FOLD}).box AS box FROM (SELECT img, list(struct_pack(box := box, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY box) AS bs FROM {BOXES} GROUP BY img)")
def nms(spark, sf_dir):
    return geometry.suppress(boxes(spark, sf_dir), ["img"], 0.5).select("img", "box")


@query(f"WITH k AS (SELECT img, lvl, unnest({_FOLD}).box AS box FROM (SELECT img, box % 3 AS lvl, list(struct_pack(box := box, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY box) AS bs FROM (SELECT *, row_number() OVER (PARTITION BY img, box % 3 ORDER BY box) AS r FROM {BOXES}) WHERE r <= 2 GROUP BY ALL)) SELECT img, box, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY box) AS rank FROM k) WHERE rank <= 3")
def rpn_topk(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("lvl", F.col("box") % 3).withColumn("score", -F.col("box").cast("double"))
    return geometry.proposals(b, "img", "lvl", 2, 3, 0.5).select("img", "box", "rank")


@query(f"SELECT img, box, least(greatest(x1, 0), 40) AS x1, least(greatest(y1, 0), 40) AS y1, least(greatest(x2, 0), 40) AS x2, least(greatest(y2, 0), 40) AS y2 FROM {BOXES} WHERE least(x2, 40) - least(x1, 40) > 0 AND least(y2, 40) - least(y1, 40) > 0")
def box_clip_nonempty(spark, sf_dir):
    c = B.clip(_cols(), 40, 40)
    return boxes(spark, sf_dir).select("img", "box", *(v.alias(n) for v, n in zip(c, _XY, strict=True))).where(B.nonempty(_cols()))


@query(f"SELECT img, box, round(x1 / 100, 6) AS nx1, round(y2 / 80, 6) AS ny2, (x2 - x1) * (y2 - y1) AS area, x1 + x2 - 1 AS far_x, greatest(least(floor(4 + log2(sqrt((x2 - x1) * (y2 - y1)) / 224 + 1e-8)), 5), 2)::INTEGER AS level FROM {BOXES}")
def box_normalise(spark, sf_dir):
    n = B.normalised(_cols(), 100, 80)
    return boxes(spark, sf_dir).select("img", "box", F.round(n[0], 6).alias("nx1"), F.round(n[3], 6).alias("ny2"), B.area(_cols()).alias("area"), B.xywh_to_xyxy(*_cols())[2].alias("far_x"), B.pyramid_level(_cols()).alias("level"))


@query(f"SELECT a.img, a.box, b.box AS box2, round((b.x1 + 0.5 * (b.x2 - b.x1) - a.x1 - 0.5 * (a.x2 - a.x1)) / (a.x2 - a.x1), 5) AS dx, round(ln((b.y2 - b.y1) / (a.y2 - a.y1)), 5) AS dh, round(b.x1, 4) AS back_x1 FROM {BOXES} a JOIN {BOXES} b ON a.img = b.img AND a.box < b.box")
def box_deltas(spark, sf_dir):
    d = B.encode(_cols(), _cols("o_"))
    return _paired(spark, sf_dir).where("box < box2").select("img", "box", "box2", F.round(d[0], 5).alias("dx"), F.round(d[3], 5).alias("dh"), F.round(B.decode(_cols(), d)[0], 4).alias("back_x1"))


@query("SELECT r AS row, c AS col, (i * 3 + j) AS anchor, round(-sqrt(s * s / a) / 2 + c * 16, 5) AS x1, round(a * sqrt(s * s / a) / 2 + r * 16, 5) AS y2 FROM (SELECT unnest([32.0, 64.0]) AS s, unnest(range(2))::INT AS i), (SELECT unnest([0.5, 1.0, 2.0]) AS a, unnest(range(3))::INT AS j), (SELECT unnest(range(6))::INT AS r), (SELECT unnest(range(8))::INT AS c)")
def anchor_grid(spark, sf_dir):
    g = geometry.anchor_grid(geometry.cell_anchors(spark, [32, 64], [0.5, 1.0, 2.0]), 6, 8, 16)
    return g.select("row", "col", "anchor", F.round("x1", 5).alias("x1"), F.round("y2", 5).alias("y2"))


@query(f"""
    WITH p AS (SELECT a.img, a.box, b.box AS truth, {_iou_sql('a', 'b')} AS iou FROM (SELECT * FROM {BOXES} WHERE box > 2) a JOIN (SELECT * FROM {BOXES} WHERE box <= 2) b ON a.img = b.img),
    t AS (SELECT *, max(iou) OVER (PARTITION BY img, truth) AS top FROM p),
    m AS (SELECT img, box, min(truth) FILTER (WHERE iou = best) AS truth, max(iou) AS iou, bool_or(iou = top AND iou > 0) AS is_top FROM (SELECT *, max(iou) OVER (PARTITION BY img, box) AS best FROM t) GROUP BY img, box)
    SELECT img, box, truth, round(iou, 6) AS iou, CASE WHEN is_top THEN 1 WHEN iou >= 0.5 THEN 1 WHEN iou < 0.3 THEN 0 ELSE -1 END AS label FROM m""")
def iou_matcher(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return geometry.match(b.where("box > 2"), b.where("box <= 2"), "img", 0.3, 0.5).withColumn("iou", F.round("iou", 6))


@query(f"SELECT a.img, a.box, b.box AS box2, a.x1 - b.x1 AS dx, a.y1 - b.y1 AS dy FROM {BOXES} a JOIN {BOXES} b ON a.img = b.img")
def relative_distance(spark, sf_dir):
    return _paired(spark, sf_dir).select("img", "box", "box2", (F.col("x1") - F.col("o_x1")).alias("dx"), (F.col("y1") - F.col("o_y1")).alias("dy"))


@query(f"SELECT img, count(*)::INTEGER AS preds, array_to_string(list_concat(list(box ORDER BY box), list_transform(range(12 - count(*)), lambda i: 0))[:12], ',') AS boxes FROM {BOXES} GROUP BY img")
def pad_detections(spark, sf_dir):
    g = boxes(spark, sf_dir).groupBy("img").agg(F.array_sort(F.collect_list("box")).alias("b"))
    return g.select("img", F.size("b").alias("preds"), F.array_join(geometry.pad(F.col("b"), 12, F.lit(0).cast("bigint")).cast("array<string>"), ",").alias("boxes"))


_LABELS = tuple(enumerate(("gray,grey", "Dog ", "oak tree,tree", "boat")))


@query(f"SELECT img, box, printf('%s %d%%', trim(lower(string_split(label, ',')[1])), floor(score % 100)::INT) AS txt FROM {BOXES} JOIN (VALUES {values(_LABELS)}) t(id, label) ON id = box % 4")
def label_lookup_text(spark, sf_dir):
    from ..sources.readers import canonical_label

    names = local(spark, _LABELS, "id, label").select("id", canonical_label(F.col("label")).alias("label"))
    return boxes(spark, sf_dir).join(names, F.col("id") == F.col("box") % 4).select("img", "box", F.format_string("%s %d%%", "label", F.floor(F.col("score") % 100)).alias("txt"))


# ---- questions and answers

_SENTS = "list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
    WITH s AS (SELECT conv_id, unnest({_SENTS}) AS s FROM conversations WHERE role = 'user'), a AS (SELECT DISTINCT conv_id, lower(string_split(trim(text), ' ')[1]) AS a FROM conversations WHERE role = 'assistant')
    SELECT conv_id, a AS answer, md5(s[:strpos(lower(s), a) - 1] || '<hl> ' || s[strpos(lower(s), a):strpos(lower(s), a) + length(a) - 1] || ' <hl>' || s[strpos(lower(s), a) + length(a):]) AS marked_md5 FROM s JOIN a USING (conv_id) WHERE length(a) > 0 AND contains(lower(s), a)""")
def qa_cross_join(spark, sf_dir):
    from ..operators.qa import highlight_answer

    c = table(spark, sf_dir, "conversations")
    s = c.where("role = 'user'").select("conv_id", F.explode(F.filter(F.transform(F.split("text", "\\. "), lambda x: F.trim(x)), lambda x: x != "")).alias("s"))
    a = c.where("role = 'assistant'").select("conv_id", F.lower(F.get(F.split(F.trim("text"), " "), F.lit(0))).alias("answer")).distinct()
    m = s.join(a, "conv_id").where((F.length("answer") > 0) & F.contains(F.lower("s"), F.col("answer")))
    return m.select("conv_id", "answer", F.md5(highlight_answer(F.col("s"), F.col("answer"))).alias("marked_md5"))


@query(f"SELECT conv_id, turn, role, i::INTEGER AS i, md5('extract answers: ' || array_to_string(list_transform(range(1, len(ss) + 1), lambda j: CASE WHEN j - 1 = i THEN '<hl> ' || ss[j] || ' <hl>' ELSE ss[j] END), ' ')) AS input_md5 FROM (SELECT conv_id, turn, role, ss, unnest(range(len(ss))) AS i FROM (SELECT conv_id, turn, role, {_SENTS} AS ss FROM conversations))")
def qa_highlight(spark, sf_dir):
    from ..operators.qa import highlight_each

    ss = F.filter(F.transform(F.split("text", "\\. "), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(highlight_each(ss)).alias("i", "t")).select("conv_id", "turn", "role", "i", F.md5("t").alias("input_md5"))


_ELEM = f"(SELECT img, ({sql_list(('dog', 'cat', 'boat', 'tree', 'house'))})[box % 5 + 1] AS element, (score % 1000) / 1000 AS score FROM {BOXES})"


def _elements(spark, sf_dir):
    return boxes(spark, sf_dir).select("img", F.get(T.strs("dog", "cat", "boat", "tree", "house"), (F.col("box") % 5).cast("int")).alias("element"), (F.col("score") % 1000 / 1000).alias("score"))


_WANT = (("dog", ""), ("dog", "cat"), ("boat", "lion"), ("lion", ""))


@query(f"""
    WITH e AS (SELECT img, element, max(score) AS score FROM {_ELEM} GROUP BY ALL), w AS (SELECT * FROM (VALUES {values(_WANT)}) t(a, b))
    SELECT i.img, w.a, w.b, round(CASE WHEN w.b = '' THEN coalesce(x.score, 0) ELSE least(coalesce(x.score, 0), coalesce(y.score, 0)) END, 6) AS score
    FROM (SELECT DISTINCT img FROM e) i CROSS JOIN w LEFT JOIN e x ON x.img = i.img AND x.element = w.a LEFT JOIN e y ON y.img = i.img AND y.element = w.b""")
def qa_element_gate(spark, sf_dir):
    from ..operators.qa import element_scores

    e = _elements(spark, sf_dir)
    m = element_scores(e, "img")
    w = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _WANT))).alias("w")
    at = lambda c: F.coalesce(F.try_element_at("scores", c), F.lit(0.0))
    return m.select("img", "scores", w).select("img", "w.a", "w.b", F.round(F.when(F.col("w.b") == "", at(F.col("w.a"))).otherwise(F.least(at(F.col("w.a")), at(F.col("w.b")))), 6).alias("score"))


@query(f"SELECT img, 'What is in this picture?' AS question, element AS answer FROM (SELECT img, element, max(score) AS score FROM {_ELEM} GROUP BY ALL) WHERE score >= 0.21 AND element NOT IN ('cat', 'tree')")
def residual_qa(spark, sf_dir):
    used = local(spark, [("cat",), ("tree",)], "element")
    e = _elements(spark, sf_dir).groupBy("img", "element").agg(F.max("score").alias("score")).where("score >= 0.21").join(used, "element", "left_anti")
    return e.select("img", F.lit("What is in this picture?").alias("question"), F.col("element").alias("answer"))


@query()
def spatial_qa(spark, sf_dir):
    from ..operators.qa import spatial_questions

    b = boxes(spark, sf_dir).select("img", "box", *_XY, (F.col("score") % 1000 / 1000).alias("score"), F.get(T.strs(*(w for ws in ONTOLOGY.values() for w in ws)), (F.col("box") % 20).cast("int")).alias("element"))
    return spatial_questions(b, "img", 0.21)
