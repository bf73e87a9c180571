"""SQL for DuckDB that gives the same rows as the core's queries."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"


def _normal(text: str, html: bool = False) -> str:
    x = f"regexp_replace(regexp_replace({text}, '&nbsp;?', chr(160), 'g'), '&#273;?', 'đ', 'g')"
    if html:
        x = rf"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
    x = f"replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = f"replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), chr(65279), '')"
    return _spaced(x, r"[ \t\f\v]+")


def _spaced(x: str, blanks: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '{blanks}', ' ', 'g'), ' *\n *', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _metric(text: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(nfc_normalize(replace({text}, chr(160), ' '))), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def _headings(text: str) -> str:
    count = lambda p, name: f"len(regexp_extract_all({text}, '(?im){p}')) AS {name}"
    return ", ".join([
        count(r"^\s*Điều\s+\d+[A-Za-zĐđ]*(?:\.\d+)*\s*[.:)]?", "article_count"), count(r"^\s*CHƯƠNG\s+(?:[IVXLCDM]+|\d+)\b", "chapter_count"),
        count(r"^\s*(?:MỤC|TIỂU\s+MỤC)\s+(?:[IVXLCDM]+|\d+)\b", "section_count"),
    ])


STATS = rf"""clean AS (SELECT doc_id, coalesce({_normal("text")}, '') AS c FROM documents),
stats AS (SELECT doc_id::VARCHAR AS document_id, doc_id AS source_index, length(c) AS num_chars, len(list_filter(string_split(c, chr(10)), lambda l: regexp_matches(l, '\S'))) AS num_lines,
  len({_words("lower(c)")}) AS tokens_without_eos, len({_words("lower(c)")}) + 1 AS tokens_with_eos, {_headings("c")}, c = '' AS empty_after_clean FROM clean)"""

PLAN = """plans AS (SELECT m AS max_seq_length, m - 16 AS content_capacity_tokens, greatest(1, least(floor((m - 16) * 0.95)::BIGINT, m - 16)) AS target_chunk_tokens FROM (SELECT unnest([2048, 4096, 8192, 10000, 12000, 16000, 32768])::BIGINT AS m)),
chunks AS (SELECT p.*, s.tokens_without_eos AS t, CASE WHEN t <= target_chunk_tokens THEN 1 ELSE 1 + ceil((t - target_chunk_tokens) / (target_chunk_tokens - 128))::BIGINT END AS n FROM plans p, stats s),
plan AS (SELECT max_seq_length, content_capacity_tokens, target_chunk_tokens, count(*) FILTER (t > target_chunk_tokens) AS documents_over_target, round(count(*) FILTER (t > target_chunk_tokens) * 100 / count(*), 6) AS documents_over_target_percent,
  count(*) FILTER (t > content_capacity_tokens) AS documents_over_context, round(count(*) FILTER (t > content_capacity_tokens) * 100 / count(*), 6) AS documents_over_context_percent,
  sum(n)::BIGINT AS estimated_chunks, round(sum(n) / count(*), 6) AS estimated_mean_chunks_per_doc, max(n)::BIGINT AS estimated_max_chunks_for_one_doc FROM chunks GROUP BY ALL)"""


#: White space of any kind, as a class of the pattern language.
BLANKS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _groups(fields: list[str], rows: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, CASE WHEN {f} IS NULL OR {f} = '' THEN 'unknown' ELSE regexp_replace({f}, '^{BLANKS}|{BLANKS}$', '', 'g') END AS value, tokens_with_eos AS t, source_index AS o FROM {rows}" for f in fields)
    return f"""grouped AS (SELECT field, value, count(*) AS documents, round(avg(t), 6) AS mean_tokens, round(quantile_cont(t, 0.95), 6) AS p95_tokens, max(t) AS max_tokens, min(o) AS first_seen FROM ({each}) GROUP BY field, value)
SELECT field, value, documents, mean_tokens, p95_tokens, max_tokens FROM grouped QUALIFY row_number() OVER (PARTITION BY field ORDER BY documents DESC, first_seen) <= 30"""


LABELLED = "labelled AS (SELECT s.*, d.lang, d.source FROM stats s JOIN documents d ON d.doc_id = s.source_index)"
FIELDS = "document_number, title, url, legal_type, legal_sectors, issuing_authority, issuance_date, signers"
LATEST = f"latest AS (SELECT id, {FIELDS} FROM (SELECT DISTINCT id, source_index, {FIELDS} FROM metadata) QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_index DESC) = 1)"
REASONS = """limits AS (SELECT ceil(quantile_cont(tokens_with_eos, 0.95))::BIGINT AS p95 FROM stats),
reasons AS (SELECT s.*, CASE WHEN empty_after_clean THEN 'empty' WHEN tokens_with_eos > p95 THEN 'over_p95' WHEN tokens_with_eos > 19984 THEN 'over_context' ELSE 'selected' END AS reason FROM stats s, limits)"""
COUNTERS = """SELECT count(*) AS stats_rows, count(*) FILTER (reason = 'selected') AS selected_rows, count(*) FILTER (reason = 'over_p95') AS over_p95_threshold, count(*) FILTER (reason = 'over_context') AS over_context_capacity,
count(*) FILTER (empty_after_clean) AS empty_after_clean FROM """


def _split(rows: str, key: str) -> str:
    return f"""total AS (SELECT count(*) AS n, ceil(round(count(*) * 0.2, 9)) AS held, ceil(round(ceil(round(count(*) * 0.2, 9)) * 0.1 / 0.2, 9)) AS tested FROM {rows}),
ranked AS (SELECT r.*, row_number() OVER (ORDER BY md5('3407:' || {key}::VARCHAR), {key}) AS rk FROM {rows} r),
second AS (SELECT r.*, CASE WHEN rk > held THEN NULL ELSE row_number() OVER (PARTITION BY rk > held ORDER BY md5('3408:' || {key}::VARCHAR), {key}) END AS rk2 FROM ranked r, total),
split AS (SELECT s.*, CASE WHEN rk > held THEN 'train' WHEN rk2 <= tested THEN 'test' ELSE 'validation' END AS split FROM second s, total)"""


def _split_summary(rows: str) -> str:
    return f"""SELECT split, count(*) AS rows, count(DISTINCT document_id) AS documents, coalesce(sum(tokens_with_eos), 0)::BIGINT AS tokens, coalesce(min(tokens_with_eos), 0) AS min_tokens,
round(coalesce(avg(tokens_with_eos), 0), 6) AS mean_tokens, coalesce(max(tokens_with_eos), 0) AS max_tokens FROM {rows} GROUP BY split"""


PAIRS = rf"""t AS (SELECT doc_id, text, {_metric("text")} AS m FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT a.doc_id, a.m AS r, b.m AS p, a.text AS rt, b.text AS pt FROM t a JOIN t b ON b.doc_id = a.doc_id + 1),
w AS (SELECT *, {_words("r")} AS rw, {_words("p")} AS pw FROM pairs)"""


def _grams(values: str, n: int, joint: str = "chr(1)") -> str:
    return f"list_transform(range(1, len({values}) - {n - 2}), lambda i: array_to_string({values}[i:i + {n - 1}], {joint}))"


def _overlap(name: str, rows: str, ref: str, pred: str) -> str:
    return f"""{name} AS (SELECT doc_id, sum(least(r, p))::BIGINT AS m, sum(r)::BIGINT AS r, sum(p)::BIGINT AS p FROM (SELECT doc_id, g, sum(side) AS r, sum(1 - side) AS p FROM
(SELECT doc_id, 1 AS side, unnest({ref}) AS g FROM {rows} UNION ALL SELECT doc_id, 0, unnest({pred}) FROM {rows}) GROUP BY doc_id, g) GROUP BY doc_id)"""


def _f1(a: str) -> str:
    return f"CASE WHEN coalesce({a}.r, 0) = 0 AND coalesce({a}.p, 0) = 0 THEN 1.0 WHEN coalesce({a}.m, 0) = 0 THEN 0.0 ELSE 2.0 * {a}.m / ({a}.r + {a}.p) END"


NUMBERS = r"list_transform(regexp_extract_all(replace({0}, chr(160), ' '), '(?i)(?:^|[^\p{{L}}\p{{N}}_])Điều\s+(\d+[a-zđ]?(?:\.\d+)*)\b', 1), lambda x: lower(x))"
SCORES = f"""{PAIRS}, {_overlap("u1", "w", "rw", "pw")}, {_overlap("u2", "w", _grams("rw", 2), _grams("pw", 2))}, {_overlap("ua", "w", NUMBERS.format("rt"), NUMBERS.format("pt"))},
scores AS (SELECT w.doc_id, {_f1("u1")} AS rouge1_f1, {_f1("u2")} AS rouge2_f1, {_f1("ua")} AS article_heading_f1, CASE WHEN len(pw) > 1 THEN len(list_distinct({_grams("pw", 2)})) / (len(pw) - 1) ELSE 0.0 END AS distinct2,
  CASE WHEN len(pw) > 3 THEN 1 - len(list_distinct({_grams("pw", 4)})) / (len(pw) - 3) ELSE 0.0 END AS repeated_4gram_ratio, length(pt) / greatest(1, length(rt)) AS length_ratio,
  len({_words('lower(rt)')}) AS reference_tokens, len({_words('lower(pt)')}) AS generated_tokens, length(pt) / 64.0 AS seconds, (right(pt, 1) = '.')::INT AS ended
  FROM w LEFT JOIN u1 USING (doc_id) LEFT JOIN u2 USING (doc_id) LEFT JOIN ua USING (doc_id))"""
FIVE = ["rouge1_f1", "rouge2_f1", "article_heading_f1", "distinct2", "repeated_4gram_ratio"]


def _corpus() -> str:
    ctes, parts = [PAIRS], []
    for kind, orders in (("chars", 6), ("words", 4)):
        unit = "string_split({}, '')" if kind == "chars" else "list_filter(string_split({}, ' '), lambda x: x <> '')"
        joint = "" if kind == "chars" else " || chr(1)"
        sides = " UNION ALL ".join(f"SELECT doc_id, {n} AS side, {unit.format(c)} AS u FROM pairs WHERE {c} <> ''" for c, n in (("r", 1), ("p", 0)))
        ctes.append(f"{kind}_1 AS (SELECT doc_id, side, generate_subscripts(u, 1) AS pos, unnest(u) AS g1 FROM ({sides}))")
        for n in range(2, orders + 1):
            ctes.append(f"{kind}_{n} AS (SELECT *, g{n - 1}{joint} || lead(g1, {n - 1}) OVER (PARTITION BY doc_id, side ORDER BY pos) AS g{n} FROM {kind}_{n - 1})")
        for n in range(1, orders + 1):
            parts.append(f"""SELECT '{kind}' AS kind, {n} AS "order", sum(least(r, p))::BIGINT AS matches, sum(p)::BIGINT AS predicted, sum(r)::BIGINT AS expected FROM (SELECT doc_id, g{n}, sum(side) AS r, sum(1 - side) AS p FROM {kind}_{orders} WHERE g{n} IS NOT NULL GROUP BY doc_id, g{n})""")
    return f"""{", ".join(ctes)}, corpus AS ({" UNION ALL ".join(parts)})"""


BLEU = """, orders AS (SELECT "order" AS o, matches, predicted, expected, sum((matches = 0)::INT) OVER (ORDER BY "order") AS misses FROM corpus WHERE kind = 'words')
SELECT round(100 * CASE WHEN max(predicted) FILTER (o = 1) > max(expected) FILTER (o = 1) THEN 1.0 ELSE exp(1 - max(expected) FILTER (o = 1) / max(predicted) FILTER (o = 1)) END
  * exp(sum(ln(CASE WHEN matches > 0 THEN matches / predicted ELSE 1 / (pow(2.0, misses) * predicted) END)) / 4), 6) AS bleu FROM orders"""
CHRF = """, pr AS (SELECT sum(CASE WHEN predicted > 0 THEN matches / predicted ELSE 0 END) / 8 AS p, sum(CASE WHEN expected > 0 THEN matches / expected ELSE 0 END) / 8 AS r FROM corpus WHERE kind = 'chars' OR "order" <= 2)
SELECT round(CASE WHEN 4 * p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf_plus_plus FROM pr"""

LM = """records AS (SELECT event_id, event_type AS model, value AS nll_sum, event_id % 7 + 1 AS scored, least(event_id % 7 + 1, event_id % 3) AS top1, least(event_id % 7 + 1, event_id % 5) AS top5 FROM events WHERE value IS NOT NULL),
lm AS (SELECT model, count(*) AS num_documents, sum(scored)::BIGINT AS full_document_scored_tokens, sum(nll_sum) / sum(scored) AS full_document_nll, exp(least(sum(nll_sum) / sum(scored), 80)) AS full_document_perplexity,
  100.0 * sum(top1) / sum(scored) AS full_document_top1_accuracy_percent, 100.0 * sum(top5) / sum(scored) AS full_document_top5_accuracy_percent FROM records GROUP BY model)"""
LM_METRICS = ["full_document_nll", "full_document_perplexity", "full_document_top1_accuracy_percent", "full_document_top5_accuracy_percent"]
#: A page's lines, as what its tags leave behind: {0} is the text of tags that are parsed (nothing) or replaced (a space).
PAGE = """concat({title}, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN concat({t}, x, chr(10)) WHEN (i - 1) % 3 = 1 THEN concat({t}, x, chr(10), x, chr(10)) ELSE concat({t}, x, {c}, i - 1, {c}, chr(10)) END), {t}), {t})"""


def _page(tree: bool) -> str:
    made = PAGE.format(title="''" if tree else "coalesce(title, ''), ' '", t="''" if tree else "' '", c="chr(9)" if tree else "' '")
    return f"SELECT doc_id, text IS NOT NULL AS is_html, CASE WHEN text IS NULL THEN '' ELSE {_normal(made)} END AS clean FROM documents"


CANDIDATES = rf"""cleaned AS (SELECT doc_id AS source_index, coalesce({_spaced("replace(replace(replace(nfc_normalize(text), chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))", "[ \t]+")}, '') AS c FROM documents),
placed AS (SELECT *, regexp_extract(c, '(?is)^(.*?)(?:^|[^\p{{L}}\p{{N}}_])Điều\s+2\s*(?:[.:]|\b)', 0) AS hit, regexp_extract(c, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(Điều\s+2\s*(?:[.:]|\b))', 1) AS named FROM cleaned),
cut AS (SELECT *, CASE WHEN hit = '' THEN 0 ELSE length(hit) - length(named) + 1 END AS spot FROM placed),
counted AS (SELECT source_index, c, spot, len({_words("lower(c)")}) AS n, len({_words("lower(left(c, spot - 1))")}) AS head, len({_words("lower(substr(c, spot))")}) AS tail FROM cut),
sized AS (SELECT *, CASE WHEN spot > 0 THEN head WHEN n > 1152 THEN 1024 END AS prefix, CASE WHEN spot > 0 THEN tail ELSE n - 1024 END AS rest FROM counted),
fit AS (SELECT *, least(rest, 1024, 20000 - prefix) AS len FROM sized),
candidates AS (SELECT source_index, CASE WHEN c = '' THEN 'empty' WHEN n + 1 < 2 THEN 'short' WHEN prefix IS NULL OR len < 128 THEN 'no_continuation' ELSE 'selected' END AS reason, n AS tokens,
  CASE WHEN prefix IS NULL OR len < 128 THEN NULL WHEN spot > 0 THEN 'before_article_2' ELSE 'token_fallback' END AS split_method,
  CASE WHEN prefix IS NULL OR len < 128 THEN NULL ELSE prefix END AS prefix_tokens, CASE WHEN prefix IS NULL OR len < 128 THEN NULL ELSE len END AS reference_tokens FROM fit)"""


def _summary() -> str:
    return " UNION ALL ".join(f"""SELECT '{m}' AS measure, count({m}) AS count, coalesce(sum({m}), 0)::BIGINT AS sum, coalesce(min({m}), 0) AS min, round(coalesce(avg({m}), 0), 6) AS mean, round(coalesce(quantile_cont({m}, 0.5), 0), 6) AS median,
round(coalesce(quantile_cont({m}, 0.75), 0), 6) AS p75, round(coalesce(quantile_cont({m}, 0.9), 0), 6) AS p90, round(coalesce(quantile_cont({m}, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont({m}, 0.99), 0), 6) AS p99, coalesce(max({m}), 0) AS max FROM stats""" for m in ("num_chars", "num_lines", "tokens_with_eos", "article_count"))


LEAKS = " UNION ALL ".join(f"SELECT '{a}' AS left_split, '{b}' AS right_split, (SELECT count(*) FROM (SELECT document_id FROM prepared WHERE split = '{a}' AND document_id IS NOT NULL INTERSECT SELECT document_id FROM prepared WHERE split = '{b}')) AS shared" for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")))
CLEAN_HTML = rf"""SELECT doc_id, regexp_matches(text, '(?is)<!doctype\s+html\b|</?(?:html|head|body|p|div|section|article|header|footer|ul|ol|li|h[1-6]|table|thead|tbody|tfoot|tr|td|th|br|span|script|style)\b[^>]*>') AS is_html,
coalesce({_normal("text", html=True)}, '') AS clean FROM documents"""
SPLIT_DOCUMENTS = _split("(SELECT doc_id FROM documents)", "doc_id")

ORACLE: dict[str, str] = {
    "document_stats": f"WITH {STATS} SELECT * FROM stats",
    "corpus_summary": f"WITH {STATS} {_summary()}",
    "group_summary_lang": f"WITH {STATS}, {LABELLED}, {_groups(['lang'], 'labelled')}",
    "group_summary_source": f"WITH {STATS}, {LABELLED}, {_groups(['source'], 'labelled')}",
    "group_summary_sets": f"WITH {STATS}, {LABELLED}, {_groups(['lang', 'source'], 'labelled')}",
    "chunk_plan": f"WITH {STATS}, {PLAN} SELECT * FROM plan",
    "recommended_plan": f"WITH {STATS}, {PLAN} SELECT * FROM plan ORDER BY documents_over_context_percent > 5, CASE WHEN documents_over_context_percent <= 5 THEN max_seq_length END, documents_over_context_percent, max_seq_length LIMIT 1",
    "longest_documents": f"WITH {STATS} SELECT document_id, num_chars, tokens_with_eos FROM stats ORDER BY tokens_with_eos DESC, source_index LIMIT 50",
    "metadata_join_last_wins": f"WITH {LATEST} SELECT doc_id::VARCHAR AS document_id, {FIELDS} FROM (SELECT doc_id FROM documents) d LEFT JOIN latest l ON l.id = d.doc_id::VARCHAR",
    "metadata_group_summary": f"WITH {STATS}, {LATEST}, joined AS (SELECT s.*, legal_type, legal_sectors, issuing_authority FROM stats s LEFT JOIN latest l ON l.id = s.document_id), {_groups(['legal_type', 'legal_sectors', 'issuing_authority'], 'joined')}",
    "selection_reasons": f"WITH {STATS}, {REASONS} SELECT document_id, tokens_with_eos, reason FROM reasons",
    "selection_counters": f"WITH {STATS}, {REASONS} {COUNTERS} reasons",
    "selection_limit_n": f"WITH {STATS}, {REASONS} {COUNTERS} (SELECT * FROM (SELECT *, coalesce(sum((reason = 'selected')::INT) OVER (ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM reasons) WHERE k < 500)",
    "seeded_split": f"WITH {SPLIT_DOCUMENTS} SELECT doc_id, split FROM split",
    "seeded_split_summary": f"WITH {STATS}, {REASONS}, chosen AS (SELECT document_id, tokens_with_eos FROM reasons WHERE reason = 'selected'), {_split('chosen', 'document_id')} {_split_summary('split')}",
    "split_summary": _split_summary("prepared"),
    "split_leakage": LEAKS,
    "shared_train_validation": "SELECT document_id FROM prepared WHERE split = 'train' AND document_id IS NOT NULL INTERSECT SELECT document_id FROM prepared WHERE split = 'validation'",
    "structure_counts": f"WITH c AS (SELECT source_index, coalesce({_normal('text')}, '') AS c FROM prepared) SELECT source_index, {_headings('c')} FROM c",
    "html_clean_regex": CLEAN_HTML,
    "html_clean_tree": CLEAN_HTML,
    "continuation_scores": f"WITH {SCORES} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in FIVE)} FROM scores",
    "generation_means": f"WITH {SCORES} SELECT count(*) AS num_generation_documents, {', '.join(f'round(100 * avg({c}), 6) AS {c}_percent' for c in FIVE)}, round(avg(length_ratio), 6) AS average_length_ratio, round(avg(reference_tokens), 6) AS average_reference_tokens, round(avg(generated_tokens), 6) AS average_generated_tokens, round(avg(seconds), 6) AS average_generation_seconds, round(100 * avg(ended), 6) AS eos_rate_percent, round(sum(seconds), 6) AS total_generation_seconds FROM scores",
    "corpus_ngram_overlaps": f"WITH {_corpus()} SELECT * FROM corpus",
    "corpus_bleu": f"WITH {_corpus()} {BLEU}",
    "corpus_chrf": f"WITH {_corpus()} {CHRF}",
    "score_windows": f"""WITH {STATS}, k AS (SELECT document_id, tokens_with_eos AS t, unnest(range(0, 1 + CASE WHEN tokens_with_eos > 512 THEN ceil((tokens_with_eos - 512) / 128)::BIGINT ELSE 0 END)) AS w FROM stats),
e AS (SELECT *, least(512 + w * 128, t) AS e, CASE WHEN w = 0 THEN 0 ELSE least(512 + (w - 1) * 128, t) END AS l FROM k)
SELECT document_id, w AS "window", greatest(0, e - 512) AS "begin", e AS "end", greatest(l, greatest(0, e - 512) + 1) AS score_from FROM e""",
    "lm_metrics": f"WITH {LM} SELECT model, num_documents, full_document_scored_tokens, {', '.join(f'round({c}, 6) AS {c}' for c in LM_METRICS)} FROM lm",
    "model_comparison": f"WITH {LM} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(a.{c}, 6) AS base, round(b.{c}, 6) AS finetuned, round(b.{c} - a.{c}, 6) AS delta_finetuned_minus_base, round({'a' if i < 2 else 'b'}.{c} - {'b' if i < 2 else 'a'}.{c}, 6) AS improvement, {i >= 2} AS higher_is_better FROM lm a, lm b WHERE a.model = 'view' AND b.model = 'click'" for i, c in enumerate(LM_METRICS))
    + ")",
    "progressive_loss": f"WITH {LM} SELECT event_id, round(sum(nll_sum) OVER o / sum(scored) OVER o, 6) AS nll_so_far, (sum(scored) OVER o)::BIGINT AS tokens_so_far FROM records WHERE model = 'view' WINDOW o AS (ORDER BY event_id)",
    "loss_perplexities": f"""WITH {LM}, m AS (SELECT model, sum(nll_sum) / sum(scored) AS l, max(nll_sum) AS most FROM records GROUP BY model), named AS (SELECT model || '_token_nll' AS metric, l AS value FROM m UNION ALL SELECT model || '_worst_loss', most FROM m UNION ALL SELECT model || '_accuracy', 0.5 FROM m)
SELECT metric, round(value, 4) AS value FROM named UNION ALL SELECT CASE WHEN metric LIKE '%!_loss' ESCAPE '!' THEN regexp_replace(metric, '_loss$', '_perplexity') ELSE regexp_replace(metric, '_token_nll$', '_token_perplexity') END, CASE WHEN value < 80 THEN round(exp(value), 4) ELSE 'Infinity'::DOUBLE END FROM named WHERE metric NOT LIKE '%accuracy'""",
    "best_checkpoints": """WITH s AS (SELECT floor(epoch(ts) / 60)::BIGINT AS step, avg(value) AS l FROM events GROUP BY 1), best AS (SELECT step FROM s ORDER BY l, step LIMIT 1), kept AS (SELECT step FROM (SELECT step FROM s ORDER BY step DESC LIMIT 3) UNION SELECT step FROM best)
SELECT step, step IN (SELECT step FROM best) AS best FROM kept""",
    "logit_metrics": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, embedding[label + 1]::DOUBLE AS l, list_max(embedding)::DOUBLE AS m FROM embeddings)
SELECT vec_id, round(max(m) + ln(sum(exp(v - m))) - max(l), 5) AS nll, (count(*) FILTER (v >= l) <= 1)::INT AS top1, (count(*) FILTER (v >= l) <= 5)::INT AS top5 FROM x GROUP BY vec_id""",
    "pad_and_mask": f"""WITH r AS (SELECT item_id AS id, text FROM eval_passages UNION ALL SELECT doc_id, text FROM documents), i AS (SELECT id, list_append(list_transform({_words('lower(text)')}, lambda w: length(w)), 0) AS ids FROM r WHERE text IS NOT NULL),
b AS (SELECT id, ids, (row_number() OVER (ORDER BY id) - 1) // 4 AS batch FROM i), f AS (SELECT id, batch, ids, (ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8)::BIGINT - len(ids) AS free FROM b)
SELECT id, batch, array_to_string(list_concat(ids, list_transform(range(free), lambda x: 0)), ' ') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(free), lambda x: 0)), ' ') AS attention_mask,
array_to_string(list_concat(ids, list_transform(range(free), lambda x: -100)), ' ') AS labels FROM f""",
    "html_pages_tree": _page(True),
    "html_pages_regex": _page(False),
    "document_stats_codes": f"WITH {STATS} SELECT s.* REPLACE (length(c) AS tokens_without_eos, length(c) + CASE WHEN right(c, 1) = '.' THEN 0 ELSE 1 END AS tokens_with_eos) FROM stats s JOIN clean ON clean.doc_id = s.source_index",
    "document_stats_given": f"""WITH {STATS}, given AS (SELECT document_id, max({{'a': tokens_with_eos, 'b': tokens_without_eos}}) AS g FROM document_token_stats WHERE document_id IS NOT NULL GROUP BY 1)
SELECT s.* REPLACE (coalesce(g.b, s.tokens_without_eos) AS tokens_without_eos, coalesce(g.a, s.tokens_with_eos) AS tokens_with_eos) FROM stats s LEFT JOIN given USING (document_id)""",
    "prepared_documents": f"""WITH {STATS}, {REASONS}, chosen AS (SELECT document_id, source_index, num_chars, tokens_with_eos FROM reasons WHERE reason = 'selected'), {_split('chosen', 'document_id')}
SELECT document_id, document_id || '::0000' AS chunk_id, 'full_document_p95' AS chunk_type, source_index, num_chars, tokens_with_eos, md5(c) AS text_md5, split FROM split JOIN clean ON clean.doc_id = source_index""",
    "preparation_checks": "SELECT unnest(['id_mismatch', 'changed_length', 'over_threshold', 'empty_text', 'repeated_document', 'nothing_selected', 'content_without_stats', 'stats_without_content']) AS check_name, 0 AS violations",
    "preparation_manifest": f"""WITH {STATS}, {REASONS}, chosen AS (SELECT document_id, tokens_with_eos FROM reasons WHERE reason = 'selected'), {_split('chosen', 'document_id')},
counters AS ({COUNTERS} reasons), per AS ({_split_summary('split')})
SELECT name AS figure, value::DOUBLE AS value FROM (UNPIVOT (SELECT c.*, (SELECT p95 FROM limits) AS p95_threshold FROM counters c) ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT split || '.' || name, value FROM (UNPIVOT (SELECT split, rows::DOUBLE AS rows, documents::DOUBLE AS documents, tokens::DOUBLE AS tokens, min_tokens::DOUBLE AS min_tokens, mean_tokens::DOUBLE AS mean_tokens, max_tokens::DOUBLE AS max_tokens FROM per) ON COLUMNS(* EXCLUDE split) INTO NAME name VALUE value)""",
    "training_step_plan": """WITH r AS (SELECT count(*) FILTER (split = 'train') AS train_rows FROM prepared), s AS (SELECT train_rows, 16::BIGINT AS effective_batch_size, ceil(train_rows / 16)::BIGINT AS steps_per_epoch FROM r),
t AS (SELECT *, ceil(steps_per_epoch * 1.5)::BIGINT AS total_training_steps FROM s) SELECT *, ceil(total_training_steps * 0.03)::BIGINT AS warmup_steps, least(100, total_training_steps) AS eval_steps, least(10, total_training_steps) AS logging_steps FROM t""",
    "evaluation_candidates": f"WITH {CANDIDATES} SELECT * FROM candidates",
    "evaluation_selection": f"WITH {CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY md5('3407:' || source_index::VARCHAR), source_index) AS rk FROM candidates) SELECT source_index, reason FROM (SELECT *, coalesce(sum((reason = 'selected')::INT) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM o) WHERE k < 200",
    "evaluation_skips": f"WITH {CANDIDATES} SELECT reason, count(*) AS documents FROM candidates GROUP BY reason",
    "tokenized_stats": "SELECT split, count(*) AS rows, count(DISTINCT document_id) AS documents, coalesce(sum(tokens_with_eos), 0)::BIGINT AS tokens, coalesce(max(tokens_with_eos), 0) AS max_tokens FROM prepared WHERE split IN ('train', 'validation') GROUP BY split",
    "data_checks": rf"""WITH {STATS}, ids AS (SELECT DISTINCT document_id FROM document_token_stats WHERE document_id IS NOT NULL)
SELECT 'empty_text' AS check_name, count(*) FILTER (NOT coalesce(regexp_matches(text, '\S'), false)) AS violations FROM prepared UNION ALL SELECT 'over_context', count(*) FILTER (tokens_with_eos > 19984) FROM prepared
UNION ALL SELECT 'no_end_mark', count(*) FILTER (tokens_with_eos <> tokens_without_eos + 1) FROM prepared UNION ALL SELECT 'wrong_length', count(*) FILTER (length(text) <> num_chars) FROM prepared
UNION ALL SELECT 'changed_length', count(*) FILTER (length(coalesce({_normal('text')}, '')) <> num_chars) FROM prepared
UNION ALL SELECT 'repeated_source_index', count(*) FROM (SELECT source_index FROM prepared GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_stats', count(*) FROM (SELECT document_id FROM document_token_stats GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'documents_without_stats', count(*) FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT document_id FROM ids) UNION ALL SELECT 'stats_without_document', count(*) FROM ids WHERE document_id NOT IN (SELECT doc_id::VARCHAR FROM documents)
UNION ALL SELECT 'outdated_stats', count(*) FROM stats s JOIN document_token_stats g USING (document_id) WHERE s.article_count <> g.article_count UNION ALL SELECT 'leaked_train_validation', shared FROM ({LEAKS}) WHERE left_split = 'train' AND right_split = 'validation'""",
    "dataset_fingerprint": "SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws(chr(1), coalesce('v' || doc_id::VARCHAR, 'n'), coalesce('v' || text, 'n'), coalesce('v' || lang, 'n'), coalesce('v' || source, 'n'))), 1, 8))::BIGINT)::BIGINT AS hash_sum FROM documents",
    "streaming_metrics": "SELECT event_type, count(*) AS records, round(sum(value), 4) AS nll_sum, count(*) AS scored, round(sum(value) / count(*), 6) AS token_nll FROM events GROUP BY event_type",
    "streaming_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS records, round(sum(value), 4) AS nll_sum FROM events GROUP BY ALL",
}
