"""Classification, policy and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import classify as C
from larkspur.operators import review as R
from larkspur.plans.q_normalize import sql_any, sql_first
from larkspur.plans.q_quality import sql_r4
from larkspur.plans.registry import query
from larkspur.session import materialize

# Lexicon of the language categories of the generated documents (a parameter of the operators).
LANGS = [
    C.Category("en", ["the ", "and ", "with", "ment"], [" les "]),
    C.Category("fr", ["eau", "elle", " qui ", "ment"], ["the "]),
    C.Category("de", [" und ", "sch", "ein", "lang de"], ["ción"]),
    C.Category("es", ["ción", " para", " los ", "ein"], []),
]
_LEX = ", ".join(f"('{c.name}', '{t}', 'pos')" for c in LANGS for t in c.positive) + ", " + ", ".join(
    f"('{c.name}', '{t}', 'neg')" for c in LANGS for t in c.negative)
_V = "text_b"
_EV = f"""lex(cat, tok, pol) AS (VALUES {_LEX}),
  ord(cat, i) AS (VALUES {', '.join(f"('{c.name}', {i})" for i, c in enumerate(LANGS))}),
  src AS (SELECT item_id, 'title' AS source, 2.0::DOUBLE AS weight, true AS strict, lower(title) AS txt FROM text_b
    UNION ALL SELECT item_id, 'facet', 1.0, false, 'lang ' || lang FROM text_b
    UNION ALL SELECT item_id, 'description', 0.5, false, lower(description) FROM text_b),
  m AS (SELECT s.item_id, s.source, s.weight, l.cat, l.tok FROM src s JOIN lex l ON l.pol = 'pos' AND contains(s.txt, l.tok)
    LEFT JOIN (SELECT DISTINCT s2.item_id, s2.source, n.cat FROM src s2 JOIN lex n ON n.pol = 'neg' AND contains(s2.txt, n.tok) WHERE s2.strict) b
      ON b.item_id = s.item_id AND b.source = s.source AND b.cat = l.cat WHERE b.cat IS NULL),
  raw AS (SELECT m.item_id, k.cat, sum(CASE WHEN k.pol = 'pos' THEN m.weight ELSE -2 * m.weight END) AS v FROM m JOIN lex k ON k.tok = m.tok GROUP BY 1, 2 HAVING v > 0),
  prob AS (SELECT r.item_id, r.cat AS category, {sql_r4('v / sum(v) OVER (PARTITION BY r.item_id)')} AS probability, row_number() OVER (PARTITION BY r.item_id ORDER BY v DESC, i) AS rank FROM raw r JOIN ord o ON o.cat = r.cat),
  sc AS (SELECT * FROM prob UNION ALL SELECT item_id, 'unknown', 1.0, 1 FROM text_b WHERE item_id NOT IN (SELECT item_id FROM prob))"""
_TOP = f"""{_EV}, top AS (SELECT item_id, max(category) FILTER (WHERE rank = 1) AS primary_category, max(probability) FILTER (WHERE rank = 1) AS top1_confidence,
    max(probability) FILTER (WHERE rank = 1) - coalesce(max(probability) FILTER (WHERE rank = 2), 0.0) AS margin FROM sc GROUP BY item_id)"""


def scored(t):
    items = t.text_b.withColumn("facet_texts", F.array(F.concat(F.lit("lang "), "lang")))
    return C.score_categories(C.build_evidence(items, LANGS, description_chars=None), LANGS)


def classified(t):
    return C.top_categories(scored(t))


@query("cls_evidence", f"WITH {_EV} SELECT item_id, source, cat AS category, any_value(weight) AS weight, count(*) AS hits, string_agg(tok, '|' ORDER BY tok) AS tokens FROM m GROUP BY ALL", _V)
def cls_evidence(t):
    items = t.text_b.withColumn("facet_texts", F.array(F.concat(F.lit("lang "), "lang")))
    ev = C.build_evidence(items, LANGS, description_chars=None).select("item_id", F.inline("evidence"))
    return ev.select("item_id", "source", "category", "weight", F.size("tokens").cast("bigint").alias("hits"),
                     F.array_join(F.array_sort("tokens"), "|").alias("tokens"))


@query("cls_category_scores", f"WITH {_EV} SELECT item_id, category, probability FROM sc", _V)
def cls_category_scores(t):
    return scored(t).select("item_id", F.inline("scores"))


@query("cls_top_category", f"WITH {_TOP} SELECT item_id, primary_category, top1_confidence, {sql_r4('margin')} AS margin FROM top", _V)
def cls_top_category(t):
    return classified(t).select("item_id", "primary_category", "top1_confidence",
                                (F.floor(F.col("top1_top2_margin") * 1e4 + 0.5) / 1e4).alias("margin"))


_PT = "lower(title || ' ' || description || ' ' || breadcrumb_text)"
_BY_TEXT = ("coalesce(" + sql_first("p", C.SEATS) + ", " + ", ".join(
    f"CASE WHEN regexp_matches(p, '{rx}') THEN '{b}' END" for b, rx in C.SEAT_PATTERNS) + ")")
_ROOMS = "list_filter([" + ", ".join(f"CASE WHEN {sql_any('p', ts)} THEN '{r}' END" for r, ts in C.ROOMS.items()) + "], lambda x: x IS NOT NULL)"


@query("cls_profile", f"""WITH x AS (SELECT *, {_PT} AS p, CASE WHEN item_id % 3 = 0 THEN 'chair' ELSE 'sofa' END AS primary_category FROM catalog_b),
    r AS (SELECT *, {_ROOMS} AS rooms FROM x),
    a AS (SELECT item_id, primary_category, rooms, CASE WHEN primary_category = 'sofa' THEN coalesce({sql_first('p', C.SHAPES)}, 'straight') END AS sofa_shape,
       CASE WHEN primary_category = 'sofa' THEN coalesce({sql_first('p', C.FUNCTIONS)}, 'standard') END AS sofa_function,
       CASE WHEN primary_category = 'sofa' THEN CASE WHEN seat_count > 0 THEN CASE WHEN seat_count >= 4 THEN '4_plus' WHEN seat_count >= 2 THEN CAST(seat_count AS VARCHAR) END ELSE {_BY_TEXT} END END AS seat_bucket,
       {sql_any('p', C.ENVIRONMENTS['outdoor'])} OR list_contains(rooms, 'outdoor') AS o,
       {sql_any('p', C.ENVIRONMENTS['indoor'])} OR len(list_filter(rooms, lambda x: x <> 'outdoor')) > 0 AS i FROM r)
    SELECT item_id, sofa_shape, sofa_function, seat_bucket, array_to_string(rooms, ',') AS room_types,
      CASE WHEN o AND i THEN 'both' WHEN o THEN 'outdoor' WHEN i OR primary_category = 'sofa' THEN 'indoor' ELSE 'unknown' END AS environment,
      CASE WHEN primary_category = 'sofa' THEN CASE WHEN sofa_function = 'sleeper' THEN 'sleeper_sofa' WHEN sofa_shape = 'u_shaped' THEN 'u_sofa' WHEN sofa_shape = 'corner' THEN 'corner_sofa'
        WHEN sofa_shape = 'chaise' THEN 'chaise_sofa' WHEN sofa_shape = 'modular' THEN 'modular_sofa' WHEN seat_bucket = '4_plus' THEN '4_seater' WHEN seat_bucket = '3' THEN '3_seater' WHEN seat_bucket = '2' THEN '2_seater' END END AS sub_category FROM a""", "catalog_b")
def cls_profile(t):
    items = t.catalog_b.withColumns({
        "profile_text": F.lower(F.concat_ws(" ", "title", "description", "breadcrumb_text")),
        "primary_category": F.expr("IF(item_id % 3 = 0, 'chair', 'sofa')")})
    return C.derive_profile(items).select("item_id", "sofa_shape", "sofa_function", "seat_bucket",
                                          F.array_join("room_types", ",").alias("room_types"), "environment", "sub_category")


POLICIES = (C.SurfacePolicy("north", ("en", "de"), accept=0.55, min_price=50.0),
            C.SurfacePolicy("all", ("en", "de", "fr", "es"), accept=0.45, margin=0.05, completeness=0.2, require_images=False, max_price=9000.0))


def _decide_sql(p: str = "") -> str:
    return f"""CASE WHEN NOT list_contains(allowed, primary_category) AND primary_category <> 'unknown' THEN 'REJECT'
      WHEN (require_images AND NOT has_images) OR (require_price AND price_amount IS NULL) OR completeness_score < completeness
        OR coalesce(price_amount > max_price, false) OR coalesce(price_amount < min_price, false) THEN 'REJECT'
      WHEN primary_category = 'unknown' THEN 'UNCERTAIN' WHEN top1_confidence >= accept AND {sql_r4('margin')} >= min_margin THEN 'ACCEPT'
      WHEN top1_confidence <= reject THEN 'REJECT' ELSE 'UNCERTAIN' END"""


_POL = """pol(surface, allowed, accept, reject, min_margin, completeness, require_images, require_price, min_price, max_price) AS (VALUES
    ('north', ['en', 'de'], 0.55, 0.2, 0.1, 0.4, true, true, 50.0, NULL), ('all', ['en', 'de', 'fr', 'es'], 0.45, 0.2, 0.05, 0.2, false, true, NULL, 9000.0))"""
_DEC = f"""{_TOP}, {_POL}, rows AS (SELECT x.*, t.primary_category, t.top1_confidence, t.margin, p.* FROM text_b x JOIN top t USING (item_id) CROSS JOIN pol p),
    dec AS (SELECT *, {_decide_sql()} AS decision FROM rows)"""
_REASONS = f"""concat_ws(',', CASE WHEN NOT list_contains(allowed, primary_category) AND primary_category <> 'unknown' THEN 'category_not_allowed'
    WHEN (require_images AND NOT has_images) OR (require_price AND price_amount IS NULL) OR completeness_score < completeness
        OR coalesce(price_amount > max_price, false) OR coalesce(price_amount < min_price, false) THEN
      concat_ws(',', CASE WHEN require_images AND NOT has_images THEN 'missing_images' END, CASE WHEN require_price AND price_amount IS NULL THEN 'missing_price' END,
        CASE WHEN completeness_score < completeness THEN 'low_completeness' END, CASE WHEN price_amount > max_price THEN 'price_above_max' END, CASE WHEN price_amount < min_price THEN 'price_below_min' END)
    WHEN primary_category = 'unknown' THEN 'unclassified' WHEN decision = 'ACCEPT' THEN 'meets_thresholds' WHEN top1_confidence <= reject THEN 'low_confidence'
    ELSE concat_ws(',', CASE WHEN top1_confidence < accept THEN 'below_accept_threshold' END, CASE WHEN {sql_r4('margin')} < min_margin THEN 'low_margin' END) END)"""


def decisions(t):
    return C.evaluate_eligibility(C.with_policies(classified(t), POLICIES))


@query("cls_eligibility", f"WITH {_DEC} SELECT item_id, surface, decision, {_REASONS} AS reasons FROM dec", _V)
def cls_eligibility(t):
    return decisions(t).select("item_id", "surface", "decision", F.array_join(C.reason_names(F.col("reason_codes")), ",").alias("reasons"))


_OUT = f"""{_DEC}, outc AS (SELECT item_id, CASE WHEN bool_or(decision = 'ACCEPT') THEN 'accepted' WHEN bool_or(decision = 'UNCERTAIN') THEN 'uncertain' ELSE 'rejected' END AS outcome,
    string_agg(surface, ',' ORDER BY surface) FILTER (WHERE decision = 'ACCEPT') AS surfaces FROM dec GROUP BY item_id)"""


@query("cls_gold_promotion", f"WITH {_OUT} SELECT x.item_id, x.source_id, x.price_amount, o.surfaces FROM outc o JOIN text_b x USING (item_id) WHERE outcome = 'accepted'", _V)
def cls_gold_promotion(t):
    gold = C.promote_to_gold(t.text_b, decisions(t), ["source_id", "price_amount"])
    return gold.select("item_id", "source_id", "price_amount", F.array_join("eligible_surfaces", ",").alias("surfaces"))


@query("cls_review_queue", f"WITH {_OUT} SELECT item_id, 'pending' AS status FROM outc WHERE outcome = 'uncertain'", _V)
def cls_review_queue(t):
    return C.to_review_queue(decisions(t))


@query("cls_batch_counts", f"WITH {_OUT} SELECT outcome, count(*) AS items FROM outc GROUP BY outcome", _V)
def cls_batch_counts(t):
    return C.batch_counts(decisions(t))


@query("cls_policy_overrides", f"""WITH {_TOP}, per AS (SELECT source_id, count(*) AS n, sum(n_chars) AS chars FROM text_b GROUP BY source_id),
    rows AS (SELECT x.*, t.primary_category, t.top1_confidence, t.margin, ['en', 'fr', 'es', 'de'] AS allowed,
        CASE WHEN p.chars % 3 = 0 THEN 0.45::DOUBLE ELSE 0.7::DOUBLE END AS accept, 0.3::DOUBLE AS reject, CASE WHEN p.chars % 3 = 1 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS min_margin,
        0.4::DOUBLE AS completeness, p.chars % 3 = 2 AS require_images, true AS require_price, NULL::DOUBLE AS min_price, NULL::DOUBLE AS max_price
      FROM text_b x JOIN top t USING (item_id) JOIN per p USING (source_id))
    SELECT item_id, source_id, accept, {_decide_sql()} AS decision FROM rows""", _V)
def cls_policy_overrides(t):
    """Each document source is a surface; a third of them override a threshold."""
    per = t.text_b.groupBy("source_id").agg(F.sum("n_chars").alias("chars"))
    defaults = per.selectExpr(
        "source_id AS surface", "array('en', 'fr', 'es', 'de') AS allowed", "0.6D AS accept", "0.2D AS reject", "0.1D AS margin",
        "0.4D AS completeness", "true AS require_images", "true AS require_price", "double(null) AS min_price", "double(null) AS max_price")
    glob = per.agg(F.lit(0.3).alias("reject"), F.lit(0.7).alias("accept"))
    over = per.selectExpr("source_id AS surface", "IF(chars % 3 = 0, 0.45D, null) AS accept", "IF(chars % 3 = 1, 0.2D, null) AS margin",
                          "IF(chars % 3 = 2, null, false) AS require_images")
    policies = C.effective_policies(defaults, glob, over).withColumnRenamed("surface", "source_id")
    return C.evaluate_eligibility(classified(t).join(policies, "source_id")).select("item_id", "source_id", "accept", "decision")


@query("cls_training_rules", f"""WITH {_DEC}, r AS (SELECT d.*, d.source_id IN ('src1', 'src2', 'src3', 'src4') AND NOT has_images AS img,
        d.source_id LIKE 'src%1' AND primary_category = 'en' AND top1_confidence < 0.65 AS conf,
        d.source_id LIKE 'src%2' AND primary_category IN ('en', 'fr') AND contains(trim(regexp_replace(lower(title), '[^a-z0-9åäö]+', ' ', 'g')), 'ment') AS tok FROM dec d WHERE surface = 'all')
    SELECT item_id, decision AS before, CASE WHEN primary_category <> 'unknown' AND (img OR conf OR tok) THEN true ELSE false END AS would_reject,
      CASE WHEN decision <> 'REJECT' AND primary_category <> 'unknown' AND (img OR conf OR tok) AND NOT (source_id LIKE 'src%2' AND primary_category = 'fr') THEN 'REJECT' ELSE decision END AS decision FROM r""", _V)
def cls_training_rules(t):
    rows = decisions(t).where("surface = 'all'").withColumns({"before": F.col("decision"), "training_text": F.col("title")})
    pairs = t.text_b.select("source_id").distinct().select("source_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("primary_category"))
    rules = pairs.selectExpr(
        "source_id", "primary_category", "IF(source_id LIKE 'src%2', array('ment'), null) AS reject_tokens",
        "IF(source_id LIKE 'src%1' AND primary_category = 'en', 0.65D, null) AS min_confidence",
        "IF(source_id LIKE 'src%2' AND primary_category = 'fr', 'candidate', 'validated') AS runtime_status")
    source_rules = t.text_b.select("source_id").distinct().where("source_id IN ('src1', 'src2', 'src3', 'src4')").withColumn("require_images", F.lit(True))
    done = C.apply_training_rules(C.assess_training_rules(rows, rules, source_rules), "active")
    return done.select("item_id", "before", "would_reject", "decision")


_UNC = """(SELECT CASE WHEN count(*) > 1 THEN -sum(p / tot * ln(p / tot)) / ln(count(*)) ELSE 0.0 END FROM (SELECT unnest(ps) AS p, list_sum(ps) AS tot))"""


@query("cls_uncertainty", f"""WITH {_TOP}, ent AS (SELECT item_id, CASE WHEN count(*) > 1 THEN -sum(q * ln(q)) / ln(count(*)) ELSE 0.0 END AS e
      FROM (SELECT item_id, probability / sum(probability) OVER (PARTITION BY item_id) AS q FROM sc WHERE rank <= 5) z GROUP BY item_id)
    SELECT item_id, {sql_r4('least(1.0, greatest(0.0, e)) * 0.55 + (1 - margin) * 0.35 + (1 - least(1.0, abs(top1_confidence - 0.5) * 2)) * 0.10')} AS uncertainty FROM top JOIN ent USING (item_id)""", _V)
def cls_uncertainty(t):
    u = R.uncertainty(F.col("category_probabilities"), F.col("top1_confidence"), F.col("top1_top2_margin"))
    return classified(t).select("item_id", (F.floor(u * 1e4 + 0.5) / 1e4).alias("uncertainty"))


# ---- review loop --------------------------------------------------------------------------------

_L = "labels_b"


@query("cls_labels", """SELECT item_id, CASE WHEN label_decision = 'in_category' THEN true WHEN label_decision = 'not_category' THEN false WHEN action = 'accept' THEN true ELSE false END AS is_in_category
    FROM labels_b WHERE (lower(trim(label_category)) = 'en' OR label_category IS NULL) AND (label_decision IS NOT NULL OR action IN ('accept', 'reject'))""", _L)
def cls_labels(t):
    raw = t.labels_b.withColumn("is_in_category", F.lit(None).cast("boolean"))
    return R.resolve_labels(raw, "en", legacy=True, legacy_category="en").select("item_id", "is_in_category")


_GRID = ", ".join(f"({t / 100})" for t in range(30, 90, 5))
_LOW = ", ".join(f"({t / 100})" for t in range(10, 50, 5))


@query("cls_calibration", f"""WITH e AS (SELECT confidence AS c, is_in_category AS ok FROM labels_b), g(t) AS (VALUES {_GRID}, (0.60)), lo(t) AS (VALUES {_LOW}),
    n AS (SELECT CAST(t AS DOUBLE) AS t, count(*) FILTER (WHERE c >= CAST(t AS DOUBLE) AND ok) AS tp, count(*) FILTER (WHERE c >= CAST(t AS DOUBLE) AND NOT ok) AS fp, count(*) FILTER (WHERE c < CAST(t AS DOUBLE) AND ok) AS fn FROM e, g GROUP BY t),
    f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM n),
    s AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM f),
    b AS (SELECT * FROM s ORDER BY f1 DESC, t LIMIT 1),
    k AS (SELECT CAST(t AS DOUBLE) AS t, count(*) FILTER (WHERE abs(c - CAST(t AS DOUBLE)) < 0.05::DOUBLE AND ok) AS tp, count(*) FILTER (WHERE abs(c - CAST(t AS DOUBLE)) < 0.05::DOUBLE) AS n FROM e, lo GROUP BY t)
    SELECT (SELECT count(*) FROM e) AS total, floor((SELECT any_value(p) FROM s WHERE t = 0.6::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS accuracy_before, floor(b.p * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS accuracy_after,
      b.t AS accept_threshold, coalesce((SELECT min(t) FROM k WHERE n > 0 AND tp / n < 0.3), 0.2::DOUBLE) AS reject_threshold, {sql_r4('b.f1')} AS best_f1 FROM b""", _L)
def cls_calibration(t):
    return R.calibrate(t.labels_b.select("confidence", F.col("is_in_category").alias("correct")))


_HASH = """CAST(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(item_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: CASE WHEN ((a * 31 + x) & 4294967295) >= 2147483648 THEN ((a * 31 + x) & 4294967295) - 4294967296 ELSE ((a * 31 + x) & 4294967295) END)) % 10 AS BIGINT)"""


@query("cls_split", f"SELECT item_id, {_HASH} AS bucket, CASE WHEN {_HASH} < 8 THEN 'train' ELSE 'holdout' END AS split FROM labels_b", _L)
def cls_split(t):
    return R.split_samples(t.labels_b).select("item_id", "bucket", "split")


_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_TOK = f"""(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT list_filter(string_split(trim(regexp_replace(lower(description), '[^a-z0-9åäö]+', ' ', 'g')), ' '),
    lambda w: length(w) BETWEEN 3 AND 24 AND w NOT IN ({_STOP})) AS l))"""


@query("cls_training_tokens", f"SELECT item_id, array_to_string({_TOK}, ' ') AS tokens FROM text_b", _V)
def cls_training_tokens(t):
    return t.text_b.select("item_id", F.array_join(R.training_tokens(F.array("description")), " ").alias("tokens"))


def samples(t):
    """Labelled documents with their tokens; four coarse sources, so that groups reach the support bounds."""
    return R.split_samples(t.labels_b.withColumn("source_id", F.expr("concat('s', item_id % 4)"))).withColumn(
        "tokens", R.training_tokens(F.array("description")))


_SAMP = f"""smp AS (SELECT item_id, 's' || item_id % 4 AS source_id, predicted, is_in_category, has_images, confidence, {_HASH} < 8 AS train, {_TOK} AS tokens,
      trim(regexp_replace(lower(description), '[^a-z0-9åäö]+', ' ', 'g')) AS txt FROM labels_b),
    tot AS (SELECT source_id, predicted, count(*) AS total, count(*) FILTER (WHERE NOT is_in_category) AS rejects FROM smp WHERE train GROUP BY ALL HAVING count(*) >= 8),
    tk AS (SELECT source_id, predicted, tok, count(*) AS n, count(*) FILTER (WHERE NOT is_in_category) AS rj FROM (SELECT source_id, predicted, is_in_category, unnest(tokens) AS tok FROM smp WHERE train) GROUP BY ALL HAVING count(*) >= 3),
    rk AS (SELECT *, row_number() OVER (PARTITION BY source_id, predicted ORDER BY rj / n DESC, rj DESC, tok) AS rank FROM tk WHERE rj >= 3 AND rj / n >= 0.75),
    rules AS (SELECT t.*, CASE WHEN total >= 15 AND rejects / total >= 0.55 THEN CASE WHEN rejects / total >= 0.7 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END END AS min_confidence,
      coalesce((SELECT list(tok ORDER BY rank) FROM rk WHERE rk.source_id = t.source_id AND rk.predicted = t.predicted AND rank <= 8), []) AS toks FROM tot t),
    img AS (SELECT source_id FROM smp WHERE train GROUP BY source_id HAVING count(*) FILTER (WHERE NOT is_in_category) >= 5
      AND count(*) FILTER (WHERE NOT is_in_category AND NOT has_images) / count(*) FILTER (WHERE NOT is_in_category) >= 0.35)"""


@query("cls_mine_rules", f"""WITH {_SAMP} SELECT source_id, predicted, total, rejects, floor(rejects / total * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS reject_rate, min_confidence,
    array_to_string(toks, ' ') AS reject_tokens FROM rules""", _L)
def cls_mine_rules(t):
    rules = R.mine_rules(samples(t).where("split = 'train'"))
    return rules.withColumn("reject_tokens", F.array_join("reject_tokens", " "))


@query("cls_rule_gate", f"""WITH {_SAMP}, h AS (SELECT s.*, s.predicted = 'en' AS base, (coalesce(s.source_id IN (SELECT source_id FROM img), false) AND NOT has_images) OR coalesce(confidence < r.min_confidence, false)
        OR len(list_filter(coalesce(r.toks, []), lambda k: contains(txt, k))) > 0 AS rej
      FROM smp s LEFT JOIN (SELECT * FROM rules WHERE predicted = 'en') r ON r.source_id = s.source_id WHERE NOT train),
    m AS (SELECT count(*) AS holdout, count(*) FILTER (WHERE base AND is_in_category) AS base_tp, count(*) FILTER (WHERE base AND NOT is_in_category) AS base_fp, count(*) FILTER (WHERE NOT base AND is_in_category) AS base_fn,
      count(*) FILTER (WHERE base AND NOT rej AND is_in_category) AS rule_tp, count(*) FILTER (WHERE base AND NOT rej AND NOT is_in_category) AS rule_fp, count(*) FILTER (WHERE NOT (base AND NOT rej) AND is_in_category) AS rule_fn FROM h),
    p AS (SELECT *, {sql_r4('CASE WHEN base_tp + base_fp > 0 THEN base_tp / (base_tp + base_fp) ELSE 0 END')} AS base_precision, {sql_r4('CASE WHEN base_tp + base_fn > 0 THEN base_tp / (base_tp + base_fn) ELSE 0 END')} AS base_recall,
      {sql_r4('CASE WHEN rule_tp + rule_fp > 0 THEN rule_tp / (rule_tp + rule_fp) ELSE 0 END')} AS rule_precision, {sql_r4('CASE WHEN rule_tp + rule_fn > 0 THEN rule_tp / (rule_tp + rule_fn) ELSE 0 END')} AS rule_recall FROM m),
    d AS (SELECT *, {sql_r4('rule_precision - base_precision')} AS precision_delta, {sql_r4('rule_recall - base_recall')} AS recall_delta FROM p)
    SELECT holdout, base_tp, base_fp, base_fn, rule_tp, rule_fp, rule_fn, base_precision, base_recall, rule_precision, rule_recall, precision_delta, recall_delta,
      CASE WHEN holdout < 40 THEN 'insufficient_holdout' WHEN precision_delta >= 0.03 AND recall_delta >= -0.08 THEN 'pass' ELSE 'precision_or_recall_regression' END AS verdict FROM d""", _L)
def cls_rule_gate(t):
    s = samples(t).withColumn("rule_text", F.trim(F.regexp_replace(F.lower("description"), "[^a-z0-9åäö]+", " ")))
    train = s.where("split = 'train'")
    hold = R.rejected_by_rules(s.where("split = 'holdout'"), R.mine_rules(train), R.mine_image_rules(train), "en")
    return R.rule_gate(hold, "en").drop("base_f1", "rule_f1")


@query("cls_eval_report", """WITH r AS (SELECT predicted AS category, CASE WHEN action = 'accept' OR correct_category = predicted THEN 1 ELSE 0 END AS tp, CASE WHEN action = 'reject' OR correct_category <> predicted THEN 1 ELSE 0 END AS fp, 0 AS fn FROM labels_b
      UNION ALL SELECT correct_category, 0, 0, 1 FROM labels_b WHERE action = 'reclassify' AND correct_category <> predicted
      UNION ALL SELECT 'rejected', 0, 0, 0 FROM labels_b WHERE action = 'reject'),
    s AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r GROUP BY category),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS a, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS b FROM s)
    SELECT category, tp, fp, fn, floor(a * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS precision, floor(b * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS recall,
      floor(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS f1 FROM p""", _L)
def cls_eval_report(t):
    return R.evaluation_report(t.labels_b)


_SHA = "sha256('0:' || CAST(item_id AS VARCHAR))"


@query("cls_sample_diverse", f"""WITH r AS (SELECT item_id, predicted AS category, row_number() OVER (PARTITION BY predicted ORDER BY {_SHA}) AS rn FROM labels_b)
    SELECT item_id, category FROM r ORDER BY rn > greatest(1, 50 // (SELECT count(DISTINCT predicted) FROM labels_b)), {_SHA} LIMIT 50""", _L)
def cls_sample_diverse(t):
    return R.sample_items(t.labels_b.select("item_id", F.col("predicted").alias("category")), "diverse", 50)


@query("cls_sample_target")
def cls_sample_target(t):
    """The hint is looked for in the whole text, before the join, so that no text is shuffled."""
    texts = t.documents.selectExpr("doc_id", "source AS source_id", "lang AS category", "contains(lower(text), 'the') AS is_hint")
    items = t.labels.select("doc_id").join(texts, "doc_id").withColumnRenamed("doc_id", "item_id")
    return R.target_sample(items, "en", 40, checkpoint=lambda df: materialize(df, "sample"))


@query("cls_apply_reviews", """WITH l AS (SELECT item_id AS id, arg_max(action, label_id) AS action, arg_max(coalesce(correct_category, '-'), label_id) AS cc FROM labels_b WHERE item_id % 9 <> 0 GROUP BY 1)
    SELECT g.item_id, g.title, CASE WHEN l.action = 'reclassify' AND l.cc <> '-' THEN l.cc ELSE g.type_tag END AS category, false AS human_verified
    FROM items_b g LEFT JOIN l ON l.id = g.item_id WHERE g.is_active AND coalesce(l.action, '') NOT IN ('accept', 'reject')
    UNION ALL SELECT i.item_id, i.title, i.type_tag, true FROM items_b i JOIN l ON l.id = i.item_id WHERE l.action = 'accept'""", "labels_b items_b")
def cls_apply_reviews(t):
    items = t.items_b.select("item_id", "title", F.col("type_tag").alias("category"))
    gold = items.join(t.items_b.where("is_active").select("item_id"), "item_id", "left_semi").withColumn("human_verified", F.lit(False))
    labels = t.labels_b.selectExpr("item_id", "label_id", "label_id AS created_at", "action", "correct_category", "item_id % 9 = 0 AS training_only")
    return R.apply_reviews(gold, items, labels)
