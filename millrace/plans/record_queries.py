"""Queries on caption pairs, answers, question lists and array layouts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import corpus, grouping, records, tensors
from .fixtures import BOXES, CAPTIONS, LINES, STOPWORDS, boxes, captions, lines, local, ontology_rows, sql_list, table, values
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


# ---- captions and answers

_TAILS = (" image", " by person", " s team -", "")
_PAIRS = f"""(SELECT idx, CASE WHEN idx % 4 = 0 THEN 'actor ' ELSE '' END || txt AS txt,
    CASE WHEN idx % 8 < 6 THEN 'actress ' ELSE '' END || replace(string_split(string_split(url, '/')[-1], '.')[1], '-', ' ') || ({sql_list(_TAILS)})[idx % 4 + 1] AS slug FROM {CAPTIONS})"""


def _pairs(spark, sf_dir):
    slug = F.replace(F.substring_index(F.substring_index("url", "/", -1), ".", 1), F.lit("-"), F.lit(" "))
    head = lambda when, word: F.when(when, word).otherwise("")
    return captions(spark, sf_dir).select("idx", F.concat(head(F.col("idx") % 4 == 0, "actor "), F.col("txt")).alias("txt"), F.concat(head(F.col("idx") % 8 < 6, "actress "), slug, F.get(T.strs(*_TAILS), (F.col("idx") % 4).cast("int"))).alias("slug"))


@query(f"""
    WITH a AS (SELECT idx, txt, replace(slug, ' s ', ' ''s ') AS slug FROM {_PAIRS})
    SELECT idx, trim(CASE WHEN starts_with(slug, 'actress') AND starts_with(txt, 'actor') THEN replace(txt, 'actor', 'actress') ELSE txt END, ' .-,:;') AS txt, trim(slug, ' .-,:;') AS slug FROM a""")
def caption_pair_repair(spark, sf_dir):
    return records.repair_pair(_pairs(spark, sf_dir))


@query(f"""
    WITH a AS (SELECT idx, CASE WHEN ends_with(txt, ' image') THEN replace(txt, ' image', '') ELSE txt END AS txt, slug FROM {_PAIRS}),
    b AS (SELECT idx, CASE WHEN ends_with(slug, ' image') THEN replace(slug, ' image', '') ELSE txt END AS txt, slug FROM a)
    SELECT idx, CASE WHEN ends_with(txt, ' by person') THEN replace(txt, ' by person', '') ELSE txt END AS txt, CASE WHEN ends_with(slug, ' by person') THEN replace(slug, ' by person', '') ELSE slug END AS slug FROM b""")
def caption_suffix_drop(spark, sf_dir):
    return records.drop_suffixes(_pairs(spark, sf_dir))


@query(f"SELECT w AS phrase, count(*) AS n, length(w) < 8 AS object FROM (SELECT unnest(list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> '')) AS w FROM {CAPTIONS}) WHERE length(w) > 4 AND NOT list_contains({sql_list(STOPWORDS)}, lower(w)) GROUP BY w")
def entity_filter(spark, sf_dir):
    w = captions(spark, sf_dir).select(F.explode(T.words(F.col("txt"))).alias("phrase"))
    w = w.where(records.entity_candidate(F.col("phrase"), STOPWORDS)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("object", records.object_candidate(F.col("phrase"), STOPWORDS))


_ANSWERS = ("yes", "no", "two men", "black", "3", "nothing", "1", "a red boat", "true", "unknown")
_COMMON = ("nothing", "nowhere", "unknown", "black", "white")


@query(f"""
    SELECT idx, coalesce(map {{'0': 'one person', '1': 'one person', '2': 'two people', '3': 'three people', '4': 'four people', '5': 'five people'}}[answer], answer) AS answer
    FROM (SELECT idx, ({sql_list(_ANSWERS)})[idx % {len(_ANSWERS)} + 1] AS answer FROM {CAPTIONS}) WHERE answer NOT IN ('true', 'false', 'yes', 'no') AND (floor({_U.format(key='idx', step='gate')} * 3) = 0 OR NOT list_contains({sql_list(_COMMON)}, answer))""")
def vqa_answer_gate(spark, sf_dir):
    a = captions(spark, sf_dir).select("idx", F.get(T.strs(*_ANSWERS), (F.col("idx") % len(_ANSWERS)).cast("int")).alias("answer"))
    return a.where(records.answer_gate(F.col("answer"), F.col("idx"), _COMMON)).select("idx", records.people_answer(F.col("answer")).alias("answer"))


# ---- question lists

_PERSONS, _EMOTIONS, _AGES, _FAITHS, _RACES = ("man", "woman", "person", "young woman"), ("happy", "sad"), ("old", "young"), ("hindu", "jewish"), ("asian", "white")
_COLORS, _SHAPES = ("red", "blue"), ("round", "square")
_PHRASES = ("happy old asian man", "sad young woman", "jewish person", "young hindu doctor", "happy man doctor", "woman", "white person walking", "")
_THINGS = ("the red round house", "a blue boat", "square red", "tower", "old red and blue barn")


def _pick(words, by):
    return F.get(T.strs(*words), (by % len(words)).cast("int"))


def _flat(qa):
    return F.array_join(F.transform(qa, lambda x: F.concat(x["subject"], F.lit("="), x["qa"])), " ; ")


def _sql_in(words):
    return f"list_filter(ws, lambda w: list_contains({sql_list(words)}, w))"


@query(f"""
    WITH a AS (SELECT idx, list_filter(string_split(({sql_list(_PHRASES)})[idx % {len(_PHRASES)} + 1], ' '), lambda x: x <> '') AS ws FROM {CAPTIONS}),
    b AS (SELECT *, ws[-1] AS l, array_to_string(ws[-2:], ' ') AS two, {_sql_in([p for p in _PERSONS if p != 'person'])} AS g FROM a),
    c AS (SELECT *, CASE WHEN list_contains({sql_list(_PERSONS)}, two) OR list_contains({sql_list(_PERSONS)}, l) THEN two ELSE 'person' END AS who FROM b),
    d AS (SELECT *, string_split(who, ' ')[-1] AS one FROM c)
    SELECT idx, coalesce(array_to_string(list_filter([
        who || '=What is ' || who || ' feeling?||' || {_sql_in(_EMOTIONS)}[1], who || '=How old is ' || who || '?||' || {_sql_in(_AGES)}[1],
        one || '=What religion is ' || one || '?||' || {_sql_in(_FAITHS)}[1], one || '=What race is ' || one || '?||' || {_sql_in(_RACES)}[1],
        CASE WHEN len(ws) > 0 AND NOT contains(one, 'person') AND (list_contains({sql_list(_PERSONS)}, l) OR len(g) = 0) THEN one || '=What gender is the person?||[' || coalesce(array_to_string(list_transform(g, lambda x: '''' || x || ''''), ', '), '') || ']' END], lambda x: x IS NOT NULL), ' ; '), '') AS qa FROM d""")
def person_questions(spark, sf_dir):
    ws = T.words(_pick(_PHRASES, F.col("idx")))
    return captions(spark, sf_dir).select("idx", _flat(T.let(ws, lambda w: records.person_questions(w, _PERSONS, _EMOTIONS, _AGES, _FAITHS, _RACES))).alias("qa"))


@query(f"""
    WITH a AS (SELECT idx, string_split(({sql_list(_THINGS)})[idx % {len(_THINGS)} + 1], ' ') AS ws FROM {CAPTIONS}), b AS (SELECT *, array_to_string(ws[2:], ' ') AS t, array_to_string(ws[-2:], ' ') AS p FROM a)
    SELECT idx, coalesce(t || '=What color is ' || t || '?||' || {_sql_in(_COLORS)}[1], '') AS thing,
        concat_ws(' ; ', p || '=What color is ' || p || '?||' || {_sql_in(_COLORS)}[1], p || '=What shape is ' || p || '?||' || {_sql_in(_SHAPES)}[1]) AS place FROM b""")
def thing_questions(spark, sf_dir):
    ws = T.words(_pick(_THINGS, F.col("idx")))
    ask = lambda place: _flat(T.let(ws, lambda w: records.thing_questions(w, _COLORS, _SHAPES, place)))
    return captions(spark, sf_dir).select("idx", ask(False).alias("thing"), ask(True).alias("place"))


_KINDS, _MOODS, _TYPES = ("", "film noir", "gloomy", "fantasy"), ("gloomy",), ("", "picture", "oil art", "sketch", "poster")


@query(f"""
    WITH a AS (SELECT idx, ({sql_list(_KINDS)})[idx % 4 + 1] AS kind, ({sql_list(_TYPES)})[idx % 5 + 1] AS t FROM {CAPTIONS})
    SELECT idx, concat_ws(' ; ', CASE WHEN kind = 'gloomy' THEN 'mood type=What is the mood of this picture?||' || kind WHEN kind <> '' THEN 'genre type=What is the genre of this picture?||' || kind END,
        CASE WHEN regexp_matches(t, 'rendering|art|cartoon|illustration|drawing|sketch') OR {_U.format(key='idx', step='picture')} <= 0.5 THEN 'picture type=What type of picture is this?||' || CASE WHEN t IN ('', 'picture') THEN 'photo' ELSE t END END) AS qa FROM a""")
def picture_questions(spark, sf_dir):
    return captions(spark, sf_dir).select("idx", _flat(records.picture_questions(_pick(_KINDS, F.col("idx")), _pick(_TYPES, F.col("idx")), _MOODS, F.col("idx"))).alias("qa"))


_WS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


@query(f"SELECT idx, array_to_string(list_filter({_WS.format(t='slug')}, lambda w, i: (idx * 7 + i * 13) % 100 / 100.0 >= 0.4 AND contains(txt, w)), ', ') AS words FROM {_PAIRS}")
def regeneration_words(spark, sf_dir):
    scored = F.transform(T.words(F.col("slug")), lambda w, i: F.struct(w.alias("element"), ((F.col("idx") * 7 + (i + 1) * 13) % 100 / 100.0).alias("score")))
    return _pairs(spark, sf_dir).select("idx", records.regeneration_words(scored, F.col("txt"), 0.4).alias("words"))


_SENT = "list_transform(string_split(text, '. '), lambda s: list_filter(string_split(s, ' '), lambda w: length(w) > 6))"


@query(f"SELECT conv_id, turn, role, array_to_string(flatten({_SENT}) || ['photo', 'picture'] || CASE WHEN turn % 2 = 0 THEN [role] ELSE [] END, ',') AS answers FROM conversations")
def default_answers(spark, sf_dir):
    found = F.transform(F.split("text", "\\. "), lambda s: F.filter(F.split(s, " "), lambda w: F.length(w) > 6))
    own = F.when(F.col("turn") % 2 == 0, F.array("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(records.with_default_answers(found, ("photo", "picture"), own), ",").alias("answers"))


@query(f"SELECT idx, array_to_string(list_transform(list_sort(list_distinct(ws[1:3] || ws[2:4])), lambda w: w || '=' || CASE WHEN list_contains(ws[2:4], w) THEN 'right' ELSE 'left' END), ',') AS entries FROM (SELECT idx, {_WS.format(t='txt')} AS ws FROM {CAPTIONS})")
def map_right_wins(spark, sf_dir):
    side = lambda ws, at, name: T.let(F.array_distinct(F.slice(ws, at, 3)), lambda k: F.map_from_arrays(k, F.transform(k, lambda _: F.lit(name))))
    union = T.let(T.words(F.col("txt")), lambda ws: records.map_union(side(ws, 1, "left"), side(ws, 2, "right")))
    entries = F.array_sort(F.transform(F.map_entries(union), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return captions(spark, sf_dir).select("idx", F.array_join(entries, ",").alias("entries"))


_KEYWORDS = ("meat", "fish", "toy", "boat", "film")


@query(f"SELECT DISTINCT word FROM (SELECT p_type AS word FROM part UNION ALL SELECT unnest([category, word]) FROM (VALUES {values(ontology_rows())}) t(category, word, ord) UNION ALL SELECT unnest({sql_list(_KEYWORDS)}))")
def keyword_universe(spark, sf_dir):
    objects = table(spark, sf_dir, "part").select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_type").alias("name")))).alias("j"))
    ont = local(spark, ontology_rows(), "category, word, ord")
    return records.keyword_universe(F.col("j"), objects, ont.select("category"), ont.select("word"), local(spark, [(w,) for w in _KEYWORDS], "word"))


@query("SELECT p_partkey AS idx, array_to_string(list_transform(range(p_partkey % 5), lambda i: '<extra_id_' || i || '>') || ['<sep>'] || list_transform(range(p_partkey % 3), lambda i: '<vis_extra_id_' || i || '>'), ' ') AS tokens FROM part")
def special_tokens(spark, sf_dir):
    n, k = (F.col("p_partkey") % 5).cast("int"), (F.col("p_partkey") % 3).cast("int")
    ids = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n), lambda i: F.concat(F.lit("<extra_id_"), i.cast("string"), F.lit(">")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.array_join(records.special_tokens(F.array_append(ids, F.lit("<sep>")), n, k), " ").alias("tokens"))


@query("SELECT doc_id, unnest(range(len(m)))::INTEGER AS rank, unnest(m) AS merge FROM (SELECT doc_id, string_split(text, chr(10))[2:-2] AS m FROM documents)")
def merges_parse(spark, sf_dir):
    """Every document read as a file of merges: its lines but the first and the last."""
    from ..sources.readers import merge_lines

    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(merge_lines(F.col("text"))).alias("rank", "merge"))


# ---- rows and batches

@query(f"SELECT idx, txt, url FROM {CAPTIONS} ORDER BY idx LIMIT 1000")
def first_rows(spark, sf_dir):
    """The feature is the cut: a run over the first rows only."""
    return captions(spark, sf_dir).orderBy("idx").limit(1000).select("idx", "txt", "url")


_NO = f"(SELECT line, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no FROM {LINES})"


@query(f"SELECT 'chunk' AS kind, line_no // 500 AS batch, count(*) AS n, sum(length(line))::BIGINT AS chars FROM {_NO} GROUP BY ALL UNION ALL SELECT 'flush', line_no // 501, count(*), sum(length(line))::BIGINT FROM {_NO} GROUP BY ALL")
def flush_batches(spark, sf_dir):
    """Rows a batch when cut by size, and when the size is tested before a row is added."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), tensors.batch_of(F.col("line_no"), 500, late).alias("batch")) for k, late in (("chunk", False), ("flush", True))))).alias("b")
    rows = corpus.number_lines(lines(spark, sf_dir)).select(kinds, F.length("line").alias("c"))
    return rows.groupBy("b.kind", "b.batch").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"))


_TITLE = "left(regexp_extract(html, '<title>(.*?)</title>', 1), 3)"


@query(f"SELECT host, array_to_string(list(w ORDER BY first_page), ';') AS words FROM (SELECT string_split(url, '/')[3] AS host, {_TITLE} AS w, min(page_id) AS first_page FROM pages GROUP BY ALL) GROUP BY host")
def group_union_in_order(spark, sf_dir):
    """Beginnings of titles of each host, as they first appear."""
    p = table(spark, sf_dir, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("host"), F.left(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(3)).alias("w"))
    return grouping.union_in_order(p, "host", "w", ["page_id"]).select("host", F.array_join("values", ";").alias("words"))


# ---- boxes

_AREA = "(x2 - x1) * (y2 - y1)"


@query(f"SELECT img, box, row_number() OVER (PARTITION BY img ORDER BY {_AREA} DESC, box)::INTEGER AS place FROM {BOXES}")
def draw_order(spark, sf_dir):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return tensors.draw_order(boxes(spark, sf_dir), "img", area, "box").select("img", "box", "place")


@query(f"SELECT img, box, floor(x1 / 100 * 640)::INTEGER AS px, floor(y2 / 100 * 480)::INTEGER AS py FROM {BOXES} WHERE ((x2 / 100 - x1 / 100) + (y2 / 100 - y1 / 100)) / 2 >= 0.20")
def large_regions(spark, sf_dir):
    x1, y1, x2, y2 = (F.col(c) / 100 for c in ("x1", "y1", "x2", "y2"))
    return boxes(spark, sf_dir).where(tensors.large_region(x1, y1, x2, y2)).select("img", "box", F.floor(x1 * 640).cast("int").alias("px"), F.floor(y2 * 480).cast("int").alias("py"))


@query(f"SELECT img, box, (dense_rank() OVER (PARTITION BY img // 32 ORDER BY img) - 1)::INTEGER AS batch_index FROM {BOXES}")
def pooler_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("batch", F.floor(F.col("img") / 32))
    return tensors.pooler_boxes(b, "batch", "img").select("img", "box", "batch_index")


@query(f"SELECT img, array_to_string(list_transform(range(img % 5), lambda i: i + 1) || list_transform(range(4 - img % 5), lambda i: 0) || list(box + 1000 ORDER BY box), ' ') AS ids, (img % 5 + count(*))::INTEGER AS attended FROM {BOXES} GROUP BY img")
def joint_sequence(spark, sf_dir):
    """Text ids, padded, before the ids of the image's boxes, and how many are attended to."""
    text = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")), lambda i: i <= F.col("img") % 5)
    v = boxes(spark, sf_dir).groupBy("img").agg(F.array_sort(F.collect_list(F.col("box") + 1000)).alias("v"))
    j = v.select("img", tensors.joint_sequence(text, F.col("v"), 4).alias("j"))
    return j.select("img", F.array_join("j.ids", " ").alias("ids"), F.aggregate("j.mask", F.lit(0), lambda s, x: s + x).alias("attended"))


# ---- arrays: 64 numbers as 4 channels of 4 x 4, 8 patches of 8, or logits

_V = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _vec(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))


@query(f"SELECT vec_id, c::INTEGER AS channel, round(list_avg(v[c * 16 + 1:c * 16 + 16]), 6) + 0.0 AS mean FROM {_V}, range(4) t(c)")
def mean_pool(spark, sf_dir):
    return _vec(spark, sf_dir).select("vec_id", F.posexplode(tensors.mean_pool(F.col("v"), 4, 16)).alias("channel", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"""
    WITH a AS (SELECT vec_id, c, unnest(range(16)) AS k, unnest(v[c * 16 + 1:c * 16 + 16]) AS x FROM {_V}, range(4) t(c)), m AS (SELECT vec_id, c, avg(x) AS mean, var_pop(x) AS var FROM a GROUP BY ALL)
    SELECT vec_id, (c * 16 + k)::INTEGER AS pos, round((x - mean) / sqrt(var + 1e-5), 5) + 0.0 AS value FROM a JOIN m USING (vec_id, c)""")
def group_norm(spark, sf_dir):
    return _vec(spark, sf_dir).select("vec_id", F.posexplode(tensors.group_norm(F.col("v"), 4, 16)).alias("pos", "value")).withColumn("value", F.round("value", 5))


@query(f"SELECT vec_id, pos::INTEGER AS pos, round(v[(pos % 4) * 16 + pos // 4 + 1], 6) + 0.0 AS value FROM {_V}, range(64) t(pos)")
def anchor_layout(spark, sf_dir):
    """Scores by anchor, row and column, laid out by row, column and anchor."""
    return _vec(spark, sf_dir).select("vec_id", F.posexplode(tensors.permuted(F.col("v"), (4, 4, 4), (1, 2, 0))).alias("pos", "value")).withColumn("value", F.round("value", 6))


_LABEL = "CASE WHEN vec_id % 5 = 0 THEN -100 ELSE vec_id % 64 END"


@query(f"""
    WITH a AS (SELECT vec_id, {_LABEL} AS label, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM {_V}), b AS (SELECT vec_id, label, CASE WHEN label = -100 THEN 0.0 ELSE z - v[label + 1] END AS loss FROM a)
    SELECT vec_id % 10 AS part, round(sum(loss), 5) AS total, round(avg(CASE WHEN label <> -100 THEN loss END), 6) AS mean FROM b GROUP BY 1""")
def token_loss(spark, sf_dir):
    label = F.when(F.col("vec_id") % 5 == 0, tensors.IGNORED).otherwise((F.col("vec_id") % 64).cast("int"))
    rows = _vec(spark, sf_dir).select("vec_id", "v", label.alias("label")).withColumn("loss", tensors.token_loss(F.col("v"), F.col("label")))
    return rows.groupBy((F.col("vec_id") % 10).alias("part")).agg(F.round(F.sum("loss"), 5).alias("total"), F.round(tensors.mean_loss(F.col("loss"), F.col("label")), 6).alias("mean"))


@query(f"""
    WITH t AS (SELECT vec_id, j AS text, v[j * 8 + 1:j * 8 + 8] AS tv FROM {_V}, (VALUES (0), (5)) j(j)), p AS (SELECT vec_id, k AS patch, list_transform(range(8), lambda i: v[k * 8 + 8 - i]) AS pv FROM {_V}, range(8) k(k)),
    s AS (SELECT t.vec_id, text, patch, round(list_cosine_similarity(tv, pv), 9) AS score FROM t JOIN p USING (vec_id))
    SELECT vec_id, text::INTEGER AS text, patch::INTEGER AS patch, rank::INTEGER AS rank, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, text ORDER BY score DESC, patch) AS rank FROM s) WHERE rank <= 2""")
def patch_cosine_topk(spark, sf_dir):
    """Two texts an image, each with its two best patches of that image."""
    e = _vec(spark, sf_dir)
    images = e.select("vec_id", F.transform(tensors.parts(F.col("v"), 8, 8), F.reverse).alias("patches"))
    texts = e.select("vec_id", F.explode(F.array(*(F.struct(F.lit(j).alias("text"), F.slice("v", j * 8 + 1, 8).alias("vector")) for j in (0, 5)))).alias("t")).select("vec_id", "t.*")
    return tensors.patch_scores(texts, images, "vec_id", 2).withColumn("score", F.round("score", 6))


@query(f"""
    WITH n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT vec_id AS seq, pos, (vec_id * 7 + pos * 31) % (n + 10) AS id FROM embeddings, n, range(4) t(pos))
    SELECT seq, pos::INTEGER AS pos, id, round(list_sum(v), 5) + 0.0 AS total FROM i JOIN {_V} e ON e.vec_id = i.id""")
def embedding_gather(spark, sf_dir):
    """Sequences of four ids, of which some are unknown, with their rows of the table."""
    e = _vec(spark, sf_dir)
    size = e.count() + 10
    ids = e.select(F.col("vec_id").alias("seq"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: (F.col("vec_id") * 7 + p * 31) % size)).alias("pos", "id"))
    return tensors.gather(ids, e, "vec_id", "v").select("seq", "pos", "id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_MODULES = ("encoder.adapter.down", "visual_embedding.weight", "decoder.attention", "prefix_embedding", "shared.adapter.up")


@query(f"""
    WITH p AS (SELECT ({sql_list(_MODULES)})[p_partkey % 5 + 1] AS name, (p_size * (p_partkey % 7 + 1))::BIGINT AS n FROM part),
    s AS (SELECT CASE WHEN contains(name, 'adapter') THEN 'adapter' WHEN regexp_matches(name, 'visual_embedding|prefix_embedding') THEN 'visual' END AS part, n FROM p),
    t AS (SELECT part, sum(n)::BIGINT AS n FROM s WHERE part IS NOT NULL GROUP BY part UNION ALL SELECT 'total', sum(n)::BIGINT FROM s WHERE part IS NOT NULL)
    SELECT part, n, round(n / 222903552 * 100, 3) AS share FROM t""")
def parameter_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(_pick(_MODULES, F.col("p_partkey")).alias("name"), F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7 + 1).alias("shape"))
    return tensors.parameter_shares(p, 222903552, {"adapter": ("adapter",), "visual": ("visual_embedding", "prefix_embedding")})
