"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, filter_audit, line_dedup, near_dedup, pii, quality_rules, rule_classifier, secrets, sharding, urlfilter, whitening
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), percent=85).drop("row", "first")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.line_dedup(docs)
    n_lines, n_removed, removed, _ = map(out.__getitem__, out.columns[len(docs.columns) :])  # by place: docs may have columns of these names
    return out.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.array_join(removed, ",").alias("removed"), "text")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.url_filter(table(spark, sf_dir, "pages"), urlfilter.DEFAULT_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), ids=False, digests=True)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_classifier.classify(docs, rule_classifier.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_table(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shards(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

# The patterns of the contracts in DuckDB's dialect, which needs no care against rescans.
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _placed(kinds: dict[str, str]) -> str:
    """SQL of placed (doc_id, o, kind, match, s, e): each kind's matches, o its place, [s, e) in code points."""
    hit = "SELECT doc_id, {o} AS o, '{k}' AS kind, regexp_extract_all(t, {p}) AS m, string_split(regexp_replace(t, {p}, chr(1114109), 'g'), chr(1114109)) AS g FROM t"
    hits = " UNION ALL ".join(hit.format(o=o, k=k, p=_text(p)) for o, (k, p) in enumerate(kinds.items()))
    return f"""t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        hits AS ({hits}),
        pieces AS (SELECT doc_id, o, kind, unnest(m) AS match, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM hits WHERE len(m) > 0),
        ended AS (
            SELECT doc_id, o, kind, match, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS e FROM pieces),
        placed AS (SELECT *, e - length(match) AS s FROM ended)"""


def _digest(kinds: list[str]) -> str:
    """SQL of a span contract's rows, from t, base and added (doc_id, o, kind, s, e)."""
    spans = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e){0}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""spans AS (SELECT doc_id, o, kind, s, e FROM base UNION ALL SELECT doc_id, o, kind, s, e FROM added)
        SELECT doc_id, {counts}, sha256({spans.format(f" FILTER (o < {len(kinds)})")}) AS base_sha256, {spans.format(" FILTER (o IS NOT NULL)")} AS spans
        FROM t LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


_CLEAR = "NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.e AND p.s < b.e)"
_PERSONAL = f"""
        WITH {_placed({"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "term": r"[\p{L}\p{Nd}]{3,}"})},
        base AS (
            SELECT *, CASE WHEN o < 2 THEN lower(match) ELSE {_DIGITS} END AS name FROM placed WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN len(list_filter(string_split(match, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER), 999) > 255)) = 0
                WHEN 'card' THEN length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''),
                    lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN c >= '5' THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0
                WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15
                ELSE false END),
        texts AS (SELECT min(doc_id) AS doc_id FROM t GROUP BY t),
        terms AS (SELECT DISTINCT doc_id, lower(match) AS term FROM placed JOIN texts USING (doc_id) WHERE kind = 'term'),
        entities AS (SELECT DISTINCT doc_id, kind, name FROM base JOIN texts USING (doc_id)),
        n_t AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
        n_e AS (SELECT kind, name, count(*) AS n_e FROM entities GROUP BY kind, name),
        n_te AS (SELECT term, kind, name, count(*) AS n_te FROM entities JOIN terms USING (doc_id) GROUP BY term, kind, name),
        scored AS (SELECT *, n_te / n_t AS p, 1.2816 * 1.2816 / n_t AS z, (SELECT count(*) FROM texts) AS total FROM n_te JOIN n_t USING (term) JOIN n_e USING (kind, name)),
        flagged AS (
            SELECT DISTINCT term FROM scored WHERE (p + z / 2 - sqrt(z * (p * (1 - p) + z / 4))) / (1 + z) >= 0.5
            AND log2(n_te * total / (n_t * n_e)) >= 0.8 * log2(total / n_e)),
        added AS (SELECT * FROM placed p WHERE kind = 'term' AND lower(match) IN (SELECT term FROM flagged) AND {_CLEAR}),
        {_digest(["email", "ip", "card", "phone"])}"""
_SECRETS = f"""
        WITH {_placed({"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "entropy": "[A-Za-z0-9+/_=-]{20,}"})},
        base AS (
            SELECT * FROM placed WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(match, {_text(_ASSIGN)}, 1)) >= 8
                WHEN 'access' THEN length(match) >= 16 WHEN 'hex' THEN length(match) >= 32 ELSE false END),
        added AS (
            SELECT * FROM placed p WHERE kind = 'entropy' AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')
            AND NOT regexp_matches(match, '^([A-Za-z]{{2,}}[0-9]{{0,4}}[-_/=+]+)*[A-Za-z]{{2,}}[0-9]{{0,4}}$')
            AND NOT regexp_matches(match, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
            AND NOT regexp_matches(match, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T?[0-9]*Z?$') AND {_CLEAR}
            AND list_max(list_transform(range(1, length(match) - 18), lambda i: list_entropy(string_split(match[i:i + 19], ''))))
                >= CASE WHEN regexp_matches(match, '^[0-9a-fA-F]+$') THEN 3.0 ELSE 3.8 END),
        {_digest(["assign", "access", "hex"])}"""

_WORD = _text(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")
_GRAMS = "list_distinct(list_transform(range(1, CASE WHEN len({0}) = 0 THEN 1 ELSE greatest(len({0}) - 1, 2) END), lambda i: array_to_string({0}[i:i + 2], ' ')))"
# Items of one piece, so of 512 words at most; equal scores of an item go to the earliest passage.
_LEAKS = rf"""
        WITH read AS (
            SELECT row_number() OVER () AS it, item_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), {_WORD}) AS h FROM benchmark),
        items AS (SELECT * FROM read WHERE len(h) > 0),
        stat AS (SELECT count(*) AS n, avg(len(h)) AS average, greatest(32, max(len(h))) AS stride FROM items),
        held AS (SELECT it, len(h) AS dl, unnest(h) AS term FROM items),
        postings AS (SELECT it, dl, term, count(*) AS tf FROM held GROUP BY it, dl, term),
        df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
        impacts AS (
            SELECT it, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)) AS impact
            FROM postings JOIN df USING (term) CROSS JOIN stat),
        needs AS (SELECT it, 0.5 * sum(impact) * (1 - 1e-9) AS need FROM impacts GROUP BY it),
        split AS (
            SELECT it, h, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1114109), 'g'), chr(1114109)), lambda x: regexp_matches(x, {_WORD})) AS parts FROM items),
        halves AS (
            SELECT it, CASE WHEN len(parts) > 1 THEN regexp_extract_all(lower(array_to_string(parts[1:len(parts) - 1], ' ')), {_WORD}) ELSE h[1:len(h) // 2] END AS q,
                   CASE WHEN len(parts) > 1 THEN regexp_extract_all(lower(parts[len(parts)]), {_WORD}) ELSE h[len(h) // 2 + 1:] END AS a FROM split),
        wanted AS (SELECT it, {_GRAMS.format("q")} AS q, {_GRAMS.format("a")} AS a FROM halves),
        words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {_WORD}) AS w FROM documents),
        numbered AS (SELECT doc_id, w, stride, unnest(range(0, len(w) // stride + 1)) AS k FROM words CROSS JOIN stat),
        passages AS (SELECT doc_id, k, w[k * stride + 1:(k + 2) * stride] AS p FROM numbered),
        terms AS (SELECT doc_id, k, unnest(list_distinct(p)) AS term FROM passages),
        scored AS (SELECT doc_id, k, it, sum(impact) AS score FROM terms JOIN impacts USING (term) GROUP BY doc_id, k, it),
        found AS (SELECT doc_id, k, it, score FROM scored JOIN needs USING (it) WHERE score >= need),
        own AS (
            SELECT doc_id, k, list_concat(p, list_concat(list_transform(range(1, len(p)), lambda i: array_to_string(p[i:i + 1], ' ')),
                   list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i + 2], ' ')))) AS own FROM passages SEMI JOIN found USING (doc_id, k)),
        shares AS (
            SELECT doc_id, k, it, score, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, own)) / len(q) END AS question_overlap,
                   len(list_intersect(a, own)) / len(a) AS answer_overlap FROM found JOIN own USING (doc_id, k) JOIN wanted USING (it))
        SELECT doc_id, item_id, score, CAST(question_overlap AS DOUBLE) AS question_overlap, CAST(answer_overlap AS DOUBLE) AS answer_overlap
        FROM shares JOIN items USING (it) WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5
        QUALIFY row_number() OVER (PARTITION BY doc_id, it ORDER BY round(score, 9) DESC, k) = 1"""


_AUDIT = r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        failing AS (
            SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails FROM t),
        said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        hist AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, fails),
        orders AS (SELECT string_agg(f, '' ORDER BY k) AS o FROM (
            SELECT unnest([a, b, c, d, e]) AS f, generate_subscripts([a, b, c, d, e], 1) AS k, a || b || c || d || e AS word
            FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v2(b), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v3(c),
                (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5) GROUP BY word),
        steps AS (SELECT o, CAST(s AS INTEGER) AS s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)),
        judged AS (SELECT *, contains(fails, f) AS has, length(translate(earlier, fails, '')) < length(earlier) AS gone FROM hist, steps),
        counted AS (
            SELECT part, o AS filter_order, s AS step, f, CAST(sum(CASE WHEN NOT has AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN has AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
                CAST(sum(CASE WHEN has AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                CAST(sum(CASE WHEN has AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN has AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM judged GROUP BY part, o, s, f)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""
# DuckDB has no CRC: the table of 256 remainders comes from the polynomial, and a text's bytes run through it.
_SHARDS = """
        WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        remainders AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        t AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
        crcs AS (
            SELECT doc_id, md5(t) AS key, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
            FROM t, remainders),
        placed AS (
            SELECT *, CAST(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS place,
                CAST(sum(size) OVER (PARTITION BY key) AS BIGINT) AS g_bytes, count(*) OVER (PARTITION BY key) AS g_rows, CAST(sum(size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM crcs),
        grouped AS (SELECT *, min(before) OVER (PARTITION BY key) AS g_start FROM placed),
        dealt AS (
            SELECT *, CAST(least((CASE WHEN g_bytes * 16 <= 0.02::DOUBLE * total AND g_rows * 16 <= 0.02::DOUBLE * n THEN 2 * g_start + g_bytes ELSE 2 * before + size END) * 16 // (2 * total), 15) AS INTEGER) AS shard FROM grouped)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": _LEAKS,
    "op2_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
        classes AS (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
        grams AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
        links AS (
            SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b USING (g) WHERE a.c <> b.c
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (
            SELECT c AS node, c AS label FROM classes
            UNION SELECT b, label FROM reach JOIN links ON a = node WHERE label < b),
        component AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN component ON node = c""",
    "op3_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM split),
        counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
        worded AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto
            FROM counted WHERE n > 0),
        reaching AS (
            SELECT doc_id, s.pos AS s, e.pos AS e FROM worded s JOIN worded e USING (doc_id) WHERE e.pos >= s.pos AND e.upto - s.upto + s.n >= 50),
        runs AS (
            SELECT doc_id, s, min(e) AS e FROM reaching GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM reaching GROUP BY doc_id, e),
        texts AS (
            SELECT doc_id, s, e, string_agg(line, chr(10) ORDER BY pos) AS run FROM runs JOIN worded USING (doc_id) WHERE pos BETWEEN s AND e
            GROUP BY doc_id, s, e),
        later AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
        gone AS (SELECT DISTINCT doc_id, k, pos FROM worded JOIN later USING (doc_id) WHERE pos BETWEEN s AND e),
        marked AS (
            SELECT c.doc_id, c.k, line, n, CASE WHEN n > 0 THEN gone.k IS NOT NULL END AS hit FROM counted c LEFT JOIN gone USING (doc_id, k)),
        judged AS (
            SELECT *, coalesce(hit, last_value(hit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k)
                   AND first_value(hit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS goes FROM marked),
        islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone),
        spans AS (SELECT doc_id, min(pos) AS f, min(pos) || ':' || (max(pos) + 1) AS span FROM islands GROUP BY doc_id, island),
        removed AS (SELECT doc_id, string_agg(span, ',' ORDER BY f) AS removed FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(count(*) FILTER (n > 0) AS INTEGER) AS n_lines, CAST(count(*) FILTER (hit) AS INTEGER) AS n_removed,
               coalesce(max(removed), '') AS removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT goes), '') AS text
        FROM judged LEFT JOIN removed USING (doc_id) GROUP BY doc_id""",
    "op4_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN contains(host, 'spam') OR contains(host, 'casino') OR contains(host, 'pills')
              OR contains(path, '/wp-admin/') OR contains(path, '/cgi-bin/') THEN 'block'
            ELSE 'allow' END AS verdict FROM ruled""",
    "op8_pii": _PERSONAL,
    "op10_secrets": _SECRETS,
    "op12_filter_audit": _AUDIT,
    "op13_sharding": _SHARDS,
}
