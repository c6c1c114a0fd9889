"""Queries on prompts, captions, URLs and documents, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fixtures import CAPTIONS, DELETE, IGNORE, LINES, REPLACE, STOPWORDS, captions, lines, q, sql_list, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- prompts

_PASS = "trim(replace(replace(lower(rtrim(trim(string_split(replace(replace(replace({t}, '::', ' '), '  ', ' '), ' ,', ', '), '—')[1], '+-.;: '), '0123456789+-.;:')), '/imagine prompt:', ''), '/imagine', ''), '/ ')"


def _prompt_sql() -> str:
    t = f"SELECT string_split(line, '--')[1] AS t FROM {LINES} WHERE length(line) > 20"
    for _ in range(6):
        t = f"SELECT {_PASS.format(t='t')} AS t FROM ({t}) WHERE length(t) > 20 AND left(t, 1) <> '<'"
    key = "replace(replace(replace(replace(replace(left(t, 20), ' ', ''), '.', ''), ',', ''), '''', ''), '\"', '')"
    return f"SELECT max(t) AS text FROM (SELECT DISTINCT t FROM ({t})) GROUP BY {key} ORDER BY 1"


@query(_prompt_sql())
def prompt_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, filter, normalise six times, deduplicate by rows and by key, sort."""
    rows = lines(spark, sf_dir).where(F.length("line") > 20).select(T.once(T.normalise_prompt(T.cut_flags(F.col("line")))).alias("text")).where("text is not null")
    return rows.groupBy(T.prompt_key(F.col("text")).alias("k")).agg(F.max("text").alias("text")).select("text").orderBy("text")


@query(f"SELECT doc_id, pos::INTEGER AS pos, line FROM {LINES}")
def line_explode(spark, sf_dir):
    return lines(spark, sf_dir)


@query("SELECT DISTINCT text FROM documents")
def distinct_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text").distinct()


@query(f"SELECT replace(replace(replace(replace(replace(left(line, 20), ' ', ''), '.', ''), ',', ''), '''', ''), '\"', '') AS key, max(line) AS text FROM {LINES} GROUP BY 1")
def dedup_prefix_key(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(T.prompt_key(F.col("line")).alias("key")).agg(F.max("line").alias("text"))


# ---- captions

_IGN = f"len(list_filter({sql_list(IGNORE)}, lambda p: contains(txt, p || ' ') OR contains(txt, ' ' || p))) > 0"
_STRIP = "trim(replace(trim(trim(txt, '.')), '  ', ' '))"
_KEPT = f"(SELECT {_STRIP} AS txt, url, idx FROM {CAPTIONS})"


def _kept(spark, sf_dir):
    c = captions(spark, sf_dir)
    return c.withColumn("txt", F.trim(F.replace(F.trim(F.btrim("txt", F.lit("."))), F.lit("  "), F.lit(" "))))


@query(f"SELECT * FROM {_KEPT} WHERE NOT {_IGN}")
def caption_ignore_filter(spark, sf_dir):
    return _kept(spark, sf_dir).where(~T.has_phrase(F.col("txt"), IGNORE))


_LONGEST = T.longest_first([*DELETE, *IGNORE])
_DEL = f"list_reduce({sql_list(_LONGEST)}, lambda acc, p: replace(replace(acc, p || ' ', ''), ' ' || p, ''), {{t}})"


@query(f"SELECT idx, {_DEL.format(t='txt')} AS txt FROM {_KEPT}")
def caption_phrase_strip(spark, sf_dir):
    return _kept(spark, sf_dir).select("idx", T.delete_phrases(F.col("txt"), _LONGEST).alias("txt"))


def _replaced(t: str) -> str:
    for a, b in REPLACE:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


@query(f"SELECT idx, {_replaced('txt')} AS txt FROM {_KEPT}")
def caption_synonyms(spark, sf_dir):
    return _kept(spark, sf_dir).select("idx", T.replace_pairs(F.col("txt"), REPLACE).alias("txt"))


def _cut_tail_sql(w: str, tail, low: bool = False) -> str:
    last = "lower(acc[-1])" if low else "acc[-1]"
    return f"list_reduce(range(len({w})), lambda acc, i: CASE WHEN len(acc) > 0 AND list_contains({sql_list(tail)}, {last}) THEN acc[:greatest(len(acc) - 2, 0)] ELSE acc END, {w})"


def _edges_sql(src: str) -> str:
    """src gives idx and a text t; the result has idx and w."""
    s = f"SELECT idx, list_filter(regexp_split_to_array(trim(t, ' .-,:;'), '\\s+'), lambda x: x <> '') AS w FROM ({src})"
    s = f"SELECT idx, CASE WHEN len(w) > 2 AND list_contains({sql_list(T.DETERMINERS)}, w[1]) AND list_contains({sql_list(T.AFTER_DETERMINER)}, w[2]) THEN w[2:] ELSE w END AS w FROM ({s})"
    # the list travels in a struct, for a fold's start must have the element type
    s = f"SELECT idx, list_reduce(list_transform(range(len(w) + 1), lambda i: w), lambda acc, i: CASE WHEN len(acc) > 0 AND list_contains({sql_list(T.STOCK_TAIL)}, acc[-1]) THEN acc[:greatest(len(acc) - 2, 0)] ELSE acc END) AS w FROM ({s})"
    s = f"SELECT idx, CASE WHEN len(w) > 3 AND w[1] = 'person' AND list_contains({sql_list(T.BETWEEN_PERSONS)}, w[2]) AND w[3] = 'person' THEN CASE WHEN list_contains({sql_list(T.JOINING)}, w[2]) THEN list_concat(['people'], w[5:]) ELSE w[4:] END ELSE w END AS w FROM ({s})"
    return f"SELECT idx, w[coalesce(list_position(list_transform(w, lambda x: list_contains({sql_list(T.LEADING)}, x)), false), len(w) + 1):] AS w FROM ({s})"


_CLEAN = f"SELECT idx, {_replaced(_DEL.format(t='txt'))} AS t FROM {_KEPT} WHERE NOT {_IGN}"


@query(f"SELECT idx, array_to_string(w, ' ') AS txt FROM ({_edges_sql(_CLEAN)}) WHERE len(w) > 0")
def caption_edges(spark, sf_dir):
    return _caption_words(spark, sf_dir).select("idx", F.array_join("w", " ").alias("txt"))


def _caption_words(spark, sf_dir):
    c = _kept(spark, sf_dir).where(~T.has_phrase(F.col("txt"), IGNORE))
    t = T.replace_pairs(T.delete_phrases(F.col("txt"), _LONGEST), REPLACE)
    return c.select("idx", "url", T.once(T.clean_words(t)).alias("w")).where(F.size("w") > 0)


# ---- URLs

@query("SELECT page_id, replace(replace(replace(url_decode(url), chr(10), '. '), chr(13), ''), chr(9), '. ') AS url FROM pages")
def url_unquote(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.unquote(F.col("url")).alias("url"))


_SLUG_W = f"""
    SELECT idx, list_filter(list_filter(regexp_split_to_array(translate(string_split(string_split(string_split(url, '/')[-1], '.')[1], '?')[1], '-+_', '   '), '\\s+'), lambda x: x <> ''),
        lambda t: lower(t) = '3d' OR length(t) < 5 OR (NOT regexp_matches(t, '[0-9]') AND length(t) < 20 AND upper(t) <> t)) AS w FROM {CAPTIONS}"""
_SLUG_W = f"SELECT idx, CASE WHEN len(w) > 0 AND NOT regexp_matches(lower(w[-1]), '[aeiou]') AND NOT list_contains({sql_list(T.VOWELLESS)}, lower(w[-1])) THEN w[:greatest(len(w) - 2, 0)] ELSE w END AS w FROM ({_SLUG_W})"
_SLUG_W = f"SELECT idx, list_reduce(list_transform(range(len(w) + 1), lambda i: w), lambda acc, i: CASE WHEN len(acc) > 0 AND list_contains({sql_list(T.SLUG_TAIL)}, lower(acc[-1])) THEN acc[:greatest(len(acc) - 2, 0)] ELSE acc END) AS w FROM ({_SLUG_W})"
_SLUG_W = f"SELECT idx, w[coalesce(list_position(list_transform(w, lambda x: list_contains({sql_list(T.SLUG_HEAD)}, lower(x))), false), len(w) + 1):] AS w FROM ({_SLUG_W})"


@query(f"SELECT idx, array_to_string(w, ' ') AS slug FROM ({_SLUG_W})")
def url_slug_tokens(spark, sf_dir):
    return captions(spark, sf_dir).select("idx", F.array_join(T.slug_words(F.col("url")), " ").alias("slug"))


_SLUG_FALL = f"""
    SELECT idx, c, CASE WHEN len(s) <= 2 OR length(junk) = 0 OR length(junk) / nullif(length(array_to_string(s, '')), 0) < 0.65 THEN array_to_string(c, ' ') ELSE array_to_string(s, ' ') END AS t
    FROM (SELECT idx, s, c, regexp_replace(array_to_string(list_filter(s, lambda x: length(x) >= 3), ''), '[0-9]', '', 'g') AS junk
          FROM (SELECT idx, w AS s FROM ({_SLUG_W})) JOIN (SELECT idx, w AS c FROM ({_edges_sql(_CLEAN)}) WHERE len(w) > 0) USING (idx))"""


@query(f"SELECT idx, CASE WHEN len(list_filter({sql_list(IGNORE)}, lambda p: contains(t, p || ' '))) > 0 THEN array_to_string(c, ' ') ELSE t END AS txt2 FROM ({_SLUG_FALL})")
def slug_fallback(spark, sf_dir):
    c = _caption_words(spark, sf_dir).withColumn("s", T.once(T.slug_words(F.col("url"))))
    return c.select("idx", T.slug_or_caption(F.col("s"), F.col("w"), IGNORE).alias("txt2"))


@query("SELECT array_to_string(w[:3], ' ') AS first3, array_to_string(w[-3:], ' ') AS last3, count(*) AS n FROM (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 3 GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def first_last_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.once(T.words(F.col("text"))).alias("w")).where(F.size("w") >= 3)
    d = d.groupBy(F.array_join(F.slice("w", 1, 3), " ").alias("first3"), F.array_join(F.slice("w", -3, 3), " ").alias("last3")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "first3", "last3")


def _key_sql(t: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower(translate({t}, ',.-:', '')), '\\s+'), lambda x: length(x) >= 3), lambda x: left(x, 3)), '')"


@query(f"SELECT md5({_key_sql('text')}) AS key, count(*) AS n, min(id) AS first_id, len(list_distinct(list(text))) AS texts FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark) GROUP BY 1")
def collapse_key_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionAll(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text"))
    return d.groupBy(F.md5(T.collapse_key(F.col("text"))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.count_distinct("text").alias("texts"))


@query(f"SELECT item_id, doc_id, CASE WHEN length(b) >= length(d) THEN b ELSE d END AS text FROM (SELECT item_id, text AS b, {_key_sql('text')} AS kb FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark)) JOIN (SELECT doc_id, line AS d, {_key_sql('line')} AS kd FROM {LINES}) ON left(kb, 12) = left(kd, 12) AND (kb = kd OR contains(kb, kd) OR contains(kd, kb)) WHERE length(kb) >= 12 AND length(kd) >= 12")
def near_dup_keep_longer(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("b")).withColumn("kb", T.collapse_key(F.col("b")))
    d = lines(spark, sf_dir).select("doc_id", F.col("line").alias("d"), T.collapse_key(F.col("line")).alias("kd"))
    b, d = (x.withColumn("p", F.left(k, F.lit(12))).where(F.length(k) >= 12) for x, k in ((b, "kb"), (d, "kd")))
    met = d.join(b, "p").where((F.col("kb") == F.col("kd")) | F.contains("kb", "kd") | F.contains("kd", "kb"))
    return met.select("item_id", "doc_id", F.when(F.length("b") >= F.length("d"), F.col("b")).otherwise(F.col("d")).alias("text"))


@query(f"""
    WITH k AS (SELECT doc_id, pos, line, {_key_sql('line')} AS key FROM {LINES}),
    s AS (SELECT *, CASE WHEN key IS DISTINCT FROM lag(key) OVER w THEN 1 ELSE 0 END AS start FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s)
    SELECT doc_id, run::BIGINT AS run, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS lines_md5 FROM g GROUP BY doc_id, run""")
def run_collapse(spark, sf_dir):
    from ..operators.grouping import collapse_runs

    k = lines(spark, sf_dir).withColumn("key", T.collapse_key(F.col("line")))
    return collapse_runs(k, ["doc_id"], "pos", "key").groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("lines_md5"))


_NORM_URL = "'http:' || string_split(replace(lower(url), 'https:', 'http:'), 'http:')[-1]"


@query(f"SELECT {_NORM_URL} AS url, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_id))), ',') AS pages FROM pages GROUP BY 1")
def url_normalise_group(spark, sf_dir):
    p = table(spark, sf_dir, "pages").groupBy(T.normalise_url(F.col("url")).alias("url"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("page_id")).cast("array<string>"), ",").alias("pages"))


_HOST = "string_split(url, '/')[3]"


@query(f"SELECT host, array_to_string(list_sort(list_distinct(list_concat(list(a), list(b)))), ';') AS words FROM (SELECT {_HOST} AS host, left(regexp_extract(html, '<title>(.*?)</title>', 1), 3) AS a, left(regexp_extract(html, '<h1>(.*?)</h1>', 1), 5) AS b FROM pages) GROUP BY host")
def group_union_lists(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("host"), F.left(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(3)).alias("a"), F.left(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit(5)).alias("b"))
    return p.groupBy("host").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("b"))), ";").alias("words"))


@query(f"SELECT concat_ws(chr(9), {_HOST}, string_agg(url, ';#;' ORDER BY page_id), string_agg(page_id::VARCHAR, ';#;' ORDER BY page_id)) AS line FROM pages GROUP BY {_HOST}")
def delimited_sink_format(spark, sf_dir):
    from ..sources.sinks import group_line

    p = table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("host"), "url", "page_id")
    g = p.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("x"))
    return g.select(group_line(F.col("host"), F.col("x.url"), F.col("x.page_id").cast("array<string>")).alias("line"))


# ---- document filters

#: Lines, every ninth with the words of the placeholder page.
_MARKED = f"(SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 9 = 0 THEN line || ' ' || {q(T.PLACEHOLDER)} ELSE line END AS line FROM {LINES})"


@query(f"SELECT doc_id, pos::INTEGER AS pos, line FROM {_MARKED} WHERE line <> upper(line) AND NOT contains(line, {q(T.PLACEHOLDER)})")
def uppercase_reject(spark, sf_dir):
    marked = F.when((F.col("doc_id") + F.col("pos")) % 9 == 0, F.concat("line", F.lit(f" {T.PLACEHOLDER}"))).otherwise(F.col("line"))
    return lines(spark, sf_dir).withColumn("line", marked).where((F.col("line") != F.upper("line")) & ~F.contains("line", F.lit(T.PLACEHOLDER)))


#: Each document with some blocked words after it, more of them for some.
_SPAM = ("", " Free FREE free", " dating XXX free xxx", " viagra cialis Free viagra", " xxx")


def _count_sql(t: str, terms) -> str:
    return " + ".join(f"(length({t}) - length(replace({t}, {q(w)}, ''))) // {len(w)}" for w in terms)


@query(f"SELECT doc_id, a::INTEGER AS first_hits, b::INTEGER AS second_hits, a > 3 OR b > 3 AS rejected FROM (SELECT doc_id, {_count_sql('t', T.BLOCKED[0])} AS a, {_count_sql('t', T.BLOCKED[1])} AS b FROM (SELECT doc_id, lower(text || {sql_list(_SPAM)}[doc_id % 5 + 1]) AS t FROM documents))")
def blocklist_count(spark, sf_dir):
    t = F.lower(F.concat("text", F.get(T.strs(*_SPAM), (F.col("doc_id") % 5).cast("int"))))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", *(T.count_substrings(F.col("t"), ws).alias(f"{n}_hits") for n, ws in zip(("first", "second"), T.BLOCKED, strict=True)))
    return d.withColumn("rejected", (F.col("first_hits") > 3) | (F.col("second_hits") > 3))


_U = "('0x' || left(md5(concat_ws(':', {key}::VARCHAR, '0', '{step}')), 8))::BIGINT / 4294967296.0"


@query(f"""
    SELECT doc_id, round(sr, 6) AS stop_ratio, round(kr, 6) AS short_ratio FROM (
        SELECT doc_id, len(list_filter(w, lambda x: list_contains({sql_list(STOPWORDS)}, lower(x)))) / len(w) AS sr, len(list_filter(w, lambda x: length(x) < 5)) / len(w) AS kr
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)
    WHERE sr < 0.75 AND {_U.format(key='doc_id', step='stop')} < sr AND {_U.format(key='doc_id', step='short')} < kr""")
def stopword_ratio_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    share = lambda f: F.size(F.filter("w", f)) / F.nullif(F.size("w"), F.lit(0))
    d = d.select("doc_id", T.once(share(lambda x: F.lower(x).isin(*STOPWORDS))).alias("sr"), T.once(share(lambda x: F.length(x) < 5)).alias("kr"))
    d = d.where((F.col("sr") < 0.75) & (T.uniform(F.col("doc_id"), "stop") < F.col("sr")) & (T.uniform(F.col("doc_id"), "short") < F.col("kr")))
    return d.select("doc_id", F.round("sr", 6).alias("stop_ratio"), F.round("kr", 6).alias("short_ratio"))


#: What documents start with, for the rules to apply.
_OPENINGS = ("", "stock photo of stock ", "Field of the Invention. The present invention relates to ", "because this is pdf file * PDF *", "Description of the Prior Art: Prior Art ", "no short description ")


def _boiler_sql(t: str) -> str:
    for a, b in T.BOILERPLATE:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


@query(f"SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT doc_id, CASE WHEN starts_with(t, 'stock ') THEN regexp_replace(replace(t, 'stock', ''), '^\\s+|\\s+$', '', 'g') ELSE t END AS t FROM (SELECT doc_id, {_boiler_sql('t')} AS t FROM (SELECT doc_id, {sql_list(_OPENINGS)}[doc_id % 6 + 1] || text AS t FROM documents)))")
def boilerplate_strip(spark, sf_dir):
    t = T.strip_boilerplate(F.concat(F.get(T.strs(*_OPENINGS), (F.col("doc_id") % 6).cast("int")), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.once(t).alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n"))


_QA = "(SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 0 THEN '. Is it so?||' || role || '?||no' ELSE '' END AS l FROM conversations)"


@query(f"SELECT conv_id, turn, role, CASE WHEN mark > 0 THEN trim(string_split(left(l, mark - 1), '.')[-1] || substr(l, mark)) ELSE '' END AS qa, md5(CASE WHEN mark > 0 THEN array_to_string(string_split(left(l, mark - 1), '.')[:-2], '.') ELSE l END) AS rest_md5 FROM (SELECT *, strpos(l, '?||') AS mark FROM {_QA})")
def inline_qa_split(spark, sf_dir):
    l = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(". Is it so?||"), "role", F.lit("?||no"))).otherwise(""))  # noqa: E741
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.once(l).alias("l"))
    rest, qa = T.split_inline_qa(F.col("l"))
    return c.select("conv_id", "turn", "role", qa.alias("qa"), F.md5(rest).alias("rest_md5"))


#: What texts end with, for the genres to apply.
_ENDINGS = ("", " the Court of law", " a PATENT here", " one cell there", " Clinical trials", " courts and patents")


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, {q(w)})" for w in ws) + f" THEN {q(g)}" for g, ws in T.GENRES) + f" ELSE '' END AS genre FROM (SELECT doc_id, lower(text || {sql_list(_ENDINGS)}[doc_id % 6 + 1]) AS t FROM documents)")
def genre_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.genre(F.concat("text", F.get(T.strs(*_ENDINGS), (F.col("doc_id") % 6).cast("int")))).alias("genre"))


_SENT = "replace(replace(replace(replace({t}, '? ', '. '), '! ', '. '), '- ', '. '), '; ', '. ')"


@query(f"SELECT doc_id, md5(unnest(list_filter(list_transform(CASE WHEN len(p) > 1 THEN list_concat(p, [text]) ELSE p END, lambda x: trim(x)), lambda x: length(x) > 20))) AS sentence_md5 FROM (SELECT doc_id, text, string_split({_SENT.format(t='text')}, '. ') AS p FROM documents)")
def sentence_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.md5("s").alias("sentence_md5"))


@query("SELECT conv_id, turn, coalesce(lag(text) OVER w, '') AS prev_text, coalesce(lead(text) OVER w, '') AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def neighbour_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(w), F.lit("")).alias("prev_text"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("next_text"))


_PEOPLE = ("", " the men and a man and some German women met me and my friend today", " you and Your boys ' team", " he said his boy saw him here", " she gave her a Boy 's hat", " a Human woman , the boy and Men there")
_KEY = "(conv_id || '-' || turn || '-' || role)"


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(t, {q(w)})" for w in words) + ")"


def _pairs_sql(t: str, pairs) -> str:
    for a, b in pairs:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def _swap_sql() -> str:
    drawn = lambda name, chance: f"{_U.format(key='k', step=name)} < {chance!r}"
    rows = f"SELECT conv_id, turn, role, {_KEY} AS k, text || {sql_list(_PEOPLE)}[turn % 6 + 1] || ' .' AS t FROM conversations"
    for name, chance, asked, pairs in T.SWAPS:
        rows = f"SELECT conv_id, turn, role, k, CASE WHEN {_any_sql(asked)} AND {drawn(name, chance)} THEN {_pairs_sql('t', pairs)} ELSE t END AS t FROM ({rows})"
    ladder = " ".join(f"WHEN {_any_sql(asked)} AND {drawn(name, chance)} THEN {_pairs_sql('t', pairs)}" for name, chance, asked, pairs in T.SWAPS_ONE_OF)
    return f"SELECT conv_id, turn, role, md5({_pairs_sql('t', T.SWAP_REPAIRS)}) AS text_md5 FROM (SELECT conv_id, turn, role, CASE {ladder} ELSE t END AS t FROM ({rows}))"


@query(_swap_sql())
def gender_swap(spark, sf_dir):
    t = F.concat("text", F.get(T.strs(*_PEOPLE), (F.col("turn") % 6).cast("int")), F.lit(" ."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(T.swap_genders(t, F.concat_ws("-", "conv_id", "turn", "role"))).alias("text_md5"))


@query(f"SELECT doc_id, array_to_string(w[coalesce(list_position(list_transform(w, lambda x: list_contains({sql_list(STOPWORDS)}, lower(x))), false), len(w) + 1):], ' ') AS rest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def strip_left_stopwords(spark, sf_dir):
    w = T.words(F.col("text"))
    low = F.array_position(F.transform("w", lambda x: F.when(F.lower(x).isin(*STOPWORDS), 1).otherwise(0)), F.lit(0)).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).withColumn("i", low)
    return d.select("doc_id", F.when(F.col("i") > 0, F.array_join(F.slice("w", F.greatest("i", F.lit(1)), F.size("w")), " ")).otherwise("").alias("rest"))


AUGMENTED = (("big brown dog", "dog"), ("brown dog", "dog"), ("old oak tree", "oak tree"), ("red bicycle", "bicycle"), ("a big", "a"))


@query("SELECT idx, replace(replace(replace(replace(replace(replace(txt, 'dog', 'big brown dog'), 'big brown dog', 'dog'), 'old oak tree', 'oak tree'), 'red bicycle', 'bicycle'), 'brown dog', 'dog'), 'a big', 'a') AS txt FROM " + CAPTIONS)
def simplify_longest_first(spark, sf_dir):
    t = F.replace("txt", F.lit("dog"), F.lit("big brown dog"))
    pairs = sorted(AUGMENTED, key=lambda p: len(p[0]), reverse=True)
    return captions(spark, sf_dir).select("idx", T.replace_pairs(t, pairs).alias("txt"))
