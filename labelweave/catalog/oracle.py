"""DuckDB SQL that computes the same results as the registered queries."""

from __future__ import annotations

from labelweave.catalog.fixtures import FIXTURE_MODELS, TAXONOMY
from labelweave.functions.text import STYLE_FEATURES
from labelweave.taxonomy import DEFAULT_THRESHOLDS, DESCRIPTORS, THRESHOLD_GRID

# Entries of MLlib's English stop-word list that consist of word characters.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now cannot could ought would
""".split()

LABELS = TAXONOMY.labels
FINE = TAXONOMY.fine
EMOTIONS = TAXONOMY.emotions
DIMENSIONS = ["valence", "arousal", "dominance"]
BASE_MODELS = [name for name, _, _ in FIXTURE_MODELS]


def _join(parts, sep=",\n  "):
    return sep.join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ANNOTATIONS = (
    "annotations AS (SELECT doc_id AS id, text, rater,\n"
    "  CASE (doc_id + rater) % 13 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN NULL "
    "ELSE 'False' END AS example_very_unclear,\n  "
    + _join(
        f"CASE WHEN (doc_id * 131 + rater * 17 + {i} * 29) % {7 + i} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}"
        for i, c in enumerate(FINE)
    )
    + "\n  FROM documents, (VALUES (0), (1), (2)) AS r(rater))"
)
CLEANED = (
    "cleaned AS (SELECT * EXCLUDE (example_very_unclear) FROM annotations "
    "WHERE lower(trim(example_very_unclear)) NOT IN ('true', '1', 'yes'))"
)
COLLAPSED = (
    "collapsed AS (SELECT id, text, "
    + _join((f"max({c}) AS {c}" for c in FINE), ", ")
    + " FROM cleaned GROUP BY id, text)"
)
COARSE = (
    "coarse AS (SELECT id, text, "
    + _join(
        (f"coalesce(greatest({', '.join(s)}), 0.0)::DOUBLE AS \"{c}\"" for c, s in TAXONOMY.coarse.items()),
        ", ",
    )
    + " FROM collapsed)"
)
PRIMARY = (
    "prim AS (SELECT *, CASE "
    + " ".join(f"WHEN \"{c}\" > 0 THEN '{c}'" for c in LABELS)
    + " ELSE 'neutral' END AS primary_label FROM coarse)"
)


def _split_case(rank: str) -> str:
    return (
        f"CASE WHEN {rank} <= 0.7::DOUBLE THEN 'train' "
        f"WHEN {rank} <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END"
    )


RANKED = (
    "ranked AS (SELECT *, percent_rank() OVER (PARTITION BY primary_label "
    "ORDER BY md5('42:' || id), id) AS rnk FROM prim)"
)
SPLIT = f"splits AS (SELECT * EXCLUDE (rnk), {_split_case('rnk')} AS split FROM ranked)"
CHAIN = [ANNOTATIONS, CLEANED, COLLAPSED, COARSE, PRIMARY, RANKED, SPLIT]

_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = (
    "tok AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), "
    f"lambda t: NOT list_contains({_STOP_LIST}, t)) AS t FROM documents)"
)


def grams(n: int) -> str:
    if n == 1:
        return "t"
    return f"list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"


def gram_rows(n: int, source: str = "tok", name: str | None = None) -> str:
    return f"{name or f'g{n}'} AS (SELECT doc_id, unnest({grams(n)}) AS term FROM {source})"


def vocabulary(n: int, max_vocab: int = 20_000, min_df: int = 5) -> list[str]:
    return [
        f"c{n} AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents "
        f"FROM g{n} GROUP BY term HAVING count(DISTINCT doc_id) >= {min_df})",
        f"v{n} AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, term) - 1 AS \"index\" FROM c{n} "
        f"ORDER BY occurrences DESC, term LIMIT {max_vocab})",
    ]


WORDS = (
    "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark)"
)
_HEX = "instr('0123456789abcdef', substr(md5(term), {k}, 1))"
EMOTION = (
    "emotion AS (SELECT term, emotion FROM words, (VALUES "
    + ", ".join(f"('{e}')" for e in EMOTIONS)
    + ") AS e(emotion) WHERE instr('0123456789abcdef', substr(md5(term || ':' || emotion), 1, 1)) <= 2)"
)
VAD = (
    "vad AS (SELECT term, "
    + ", ".join(
        f"CAST(({_HEX.format(k=k)} - 1) / 16.0 AS DOUBLE) AS {d}" for k, d in enumerate(DIMENSIONS, start=1)
    )
    + " FROM words WHERE instr('0123', substr(md5(term), 4, 1)) = 0)"
)
FLAGS = (
    "flags AS (SELECT term, 1 AS known, "
    + ", ".join(f"max(CASE WHEN emotion = '{e}' THEN 1 ELSE 0 END) AS is_{e}" for e in EMOTIONS)
    + " FROM emotion GROUP BY term)"
)
TOKEN_ROWS = "tr AS (SELECT doc_id, unnest(t) AS term FROM tok)"
LEX_SUMS = (
    "lex AS (SELECT tok.doc_id, len(t) AS n, coalesce(m, 0)::DOUBLE AS m, "
    + ", ".join(f"coalesce(n_{e}, 0)::DOUBLE AS n_{e}" for e in EMOTIONS)
    + " FROM tok LEFT JOIN (SELECT doc_id, sum(known) AS m, "
    + ", ".join(f"sum(is_{e}) AS n_{e}" for e in EMOTIONS)
    + " FROM tr JOIN flags USING (term) GROUP BY doc_id) s USING (doc_id))"
)
VAD_SUMS = (
    "vs AS (SELECT tok.doc_id, len(t) AS n, coalesce(k, 0)::DOUBLE AS k, "
    + ", ".join(
        f"coalesce({d}_{s}, 0)::DOUBLE AS {d}_{s}" for d in DIMENSIONS for s in ("mean", "std", "range")
    )
    + " FROM tok LEFT JOIN (SELECT doc_id, count(*) AS k, "
    + ", ".join(
        f"avg({d}) AS {d}_mean, stddev_samp({d}) AS {d}_std, max({d}) - min({d}) AS {d}_range"
        for d in DIMENSIONS
    )
    + " FROM tr JOIN vad USING (term) GROUP BY doc_id) s USING (doc_id))"
)
_COUNTS = "[" + ", ".join(f"n_{e}" for e in EMOTIONS) + "]"
LEX_COLUMNS = (
    [f"n_{e} AS lex_count_{e}" for e in EMOTIONS]
    + [f"round(n_{e} / greatest(n, 1), 6) AS lex_ratio_{e}" for e in EMOTIONS]
    + [f"CASE WHEN n_{e} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS lex_flag_{e}" for e in EMOTIONS]
    + [
        "m AS lex_total_matches",
        "round(m / greatest(n, 1), 6) AS lex_total_ratio",
        f"CASE WHEN m = 0 THEN -1.0 ELSE list_position({_COUNTS}, list_max({_COUNTS})) - 1 END::DOUBLE "
        "AS lex_dominant_index",
    ]
)
VAD_COLUMNS = [
    f"round({d}_{s}, 6) AS vad_{d}_{s}" for d in DIMENSIONS for s in ("mean", "std", "range")
] + ["round(k / greatest(n, 1), 6) AS vad_token_coverage"]


def _exact(expression: str) -> str:
    """The expression without its rounding to six digits."""
    return expression.replace("round(", "(").replace(", 6)", ")")


def _names(columns: list[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in columns]


LEX_EXACT = [_exact(c) for c in LEX_COLUMNS]
VAD_EXACT = [_exact(c) for c in VAD_COLUMNS]


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))::DOUBLE"


_SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"
STYLE_BASE = (
    "sty AS (SELECT doc_id, len(t)::DOUBLE AS words, length(text)::DOUBLE AS chars, "
    "length(array_to_string(t, ''))::DOUBLE AS letters, "
    f"{_hits('!')} AS bang, {_hits('[?]')} AS quest, "
    f"len(list_filter(regexp_split_to_array(text, '[{_SPACES}]+'), "
    "lambda s: regexp_matches(s, '[!?]{2}')))::DOUBLE AS multi, "
    "len(list_filter(raw, lambda w: length(w) > 1 AND "
    r"regexp_matches(w, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$')))::DOUBLE AS caps, "
    "len(list_filter(raw, lambda w: regexp_matches(w, "
    r"'^[^\p{L}]*\p{Lu}\p{Ll}*([^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$')))::DOUBLE AS titles, "
    rf"{_hits('\\p{Lu}')} AS upper_chars, "
    rf"{_hits(f'[^\\p{{L}}\\p{{N}}{_SPACES}]')} AS special, "
    rf"{_hits('\\p{Nd}')} AS digits FROM (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), "
    f"lambda w: NOT list_contains({_STOP_LIST}, lower(w))) AS raw FROM tok))"
)


def style_columns(raw: bool, *, exact: bool = False) -> list[str]:
    values = [
        "words",
        "chars",
        "CASE WHEN words = 0 THEN 0 ELSE round(letters / words, 6) END::DOUBLE",
        "bang",
        "quest",
        "multi",
        "caps" if raw else "0.0::DOUBLE",
        "CASE WHEN words = 0 THEN 0 ELSE round(titles / words, 6) END::DOUBLE" if raw else "0.0::DOUBLE",
        "CASE WHEN chars = 0 THEN 0 ELSE round(upper_chars / chars, 6) END::DOUBLE",
        "special",
        "CASE WHEN words = 0 THEN 0 ELSE round((bang + quest) / words, 6) END::DOUBLE",
        "digits",
    ]
    if exact:
        values = [_exact(value) for value in values]
    return [f"{value} AS {name}" for name, value in zip(STYLE_FEATURES, values)]


SCORES = (
    "scores AS (SELECT id AS example_id, split, model, label, label_pos::INTEGER AS label_pos, y, "
    "CASE WHEN scored THEN v END AS score, CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS pred FROM "
    "(SELECT id, split, model, scored, label, label_pos, y, "
    "((id * 7919 + m * 104729 + label_pos * 1299709) % 1000)::DOUBLE / 1000.0::DOUBLE AS v FROM ("
    + " UNION ALL ".join(
        f"SELECT id, split, '{c}' AS label, {i} AS label_pos, \"{c}\" AS y FROM splits"
        for i, c in enumerate(LABELS)
    )
    + "), (VALUES "
    + ", ".join(f"('{name}', {m}, {str(scored).lower()})" for name, m, scored in FIXTURE_MODELS)
    + ") AS mods(model, m, scored)))"
)


def _pivoted(names: list[str]) -> str:
    return (
        "joined AS (SELECT example_id, split, label, label_pos, max(y) AS y, "
        + ", ".join(
            f"max(CASE WHEN model = '{m}' THEN score END) AS score_{m}, "
            f"max(CASE WHEN model = '{m}' THEN pred END) AS pred_{m}"
            for m in names
        )
        + f" FROM scores GROUP BY ALL HAVING count(DISTINCT model) = {len(names)})"
    )


_SHARE = "(" + " + ".join(f"coalesce(score_{m}, pred_{m})" for m in BASE_MODELS) + f") / {len(BASE_MODELS)}.0::DOUBLE"
VOTES = (
    "votes AS (SELECT example_id, split, 'majority_vote' AS model, label, label_pos, y, share AS score, "
    "CASE WHEN share >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS pred "
    f"FROM (SELECT *, {_SHARE} AS share FROM joined))"
)
ALL_SCORES = "every_score AS (SELECT * FROM scores UNION ALL BY NAME SELECT * FROM votes)"
WITH_VOTES = [*CHAIN, SCORES, _pivoted(BASE_MODELS), VOTES, ALL_SCORES]

_CONFIGURED = "CASE label " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in DEFAULT_THRESHOLDS.items()) + " ELSE 0.5 END::DOUBLE"


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) = 0 THEN 0.0 ELSE ({part})::DOUBLE / ({whole}) END"


GRID = (
    "counts AS (SELECT model, label, threshold, "
    "count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, "
    "count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, "
    "count(*) FILTER (WHERE score < threshold AND y = 1) AS fn "
    "FROM every_score, (VALUES "
    + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLD_GRID)
    + ") AS c(threshold) WHERE split = 'validation' AND score IS NOT NULL GROUP BY ALL),\n"
    f"pr AS (SELECT *, {_ratio('tp', 'tp + fp')} AS \"precision\", {_ratio('tp', 'tp + fn')} AS recall FROM counts),\n"
    f"grid AS (SELECT *, {_ratio('2.0 * \"precision\" * recall', '\"precision\" + recall')} AS f1 FROM pr),\n"
    "best AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY model, label "
    "ORDER BY f1 DESC, recall DESC, threshold) = 1)"
)
TUNED = (
    "tuned AS (SELECT p.model, p.label, coalesce(best.threshold, " + _CONFIGURED.replace("label", "p.label", 1) + ") "
    "AS threshold FROM (SELECT DISTINCT model, label FROM every_score WHERE split = 'validation') p "
    "LEFT JOIN best ON best.model = p.model AND best.label = p.label)"
)
CANONICAL = (
    "canon AS (SELECT example_id, split, s.model, s.label, label_pos, y, score, "
    "CASE WHEN score IS NULL THEN pred WHEN score >= threshold THEN 1.0 ELSE 0.0 END::DOUBLE AS pred, threshold "
    "FROM every_score s JOIN tuned t ON s.model = t.model AND s.label = t.label)"
)
DECIDED = [*WITH_VOTES, GRID, TUNED, CANONICAL]
CONFUSION = (
    "conf AS (SELECT model, split, label, label_pos, "
    "count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, "
    "count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1) AS support, "
    'count(*) AS "rows", sum(abs(y - pred)) AS abs_error FROM canon GROUP BY ALL)'
)
PER_LABEL = (
    f"plp AS (SELECT *, {_ratio('tp', 'tp + fp')} AS \"precision\", {_ratio('tp', 'tp + fn')} AS recall FROM conf),\n"
    f"pl AS (SELECT *, {_ratio('2.0 * \"precision\" * recall', '\"precision\" + recall')} AS f1 FROM plp)"
)
_ROUNDED = "round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1"
MICRO = (
    'mic AS (SELECT model, split, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg("precision") AS mp, '
    "avg(recall) AS mr, avg(f1) AS mf FROM pl GROUP BY ALL),\n"
    f"mic2 AS (SELECT *, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS r FROM mic)"
)

_TONE = "CASE {x} " + " ".join(f"WHEN '{c}' THEN '{tone}'" for c, (tone, _) in DESCRIPTORS.items()) + " END"
_HEADLINE = (
    "CASE {x} "
    + " ".join(f"WHEN '{c}' THEN '{h[0].upper() + h[1:]}'" for c, (_, h) in DESCRIPTORS.items())
    + " END"
)
# The k-th entry of a list ordered by score, ties in label order.
_BY_SCORE = "ORDER BY score DESC, label_pos"
SUMMARIES = (
    "flagged AS (SELECT *, CASE WHEN score IS NOT NULL THEN score >= threshold ELSE pred >= 0.5 END AS positive FROM canon),\n"
    "summ AS (SELECT example_id, model, "
    "coalesce(array_to_string(list(label ORDER BY label_pos) FILTER (WHERE positive), ','), '') AS positives, "
    f"list(label {_BY_SCORE}) FILTER (WHERE score IS NOT NULL) AS ranked_labels, "
    f"list(label {_BY_SCORE}) FILTER (WHERE score >= threshold) AS sure, "
    f"list(score {_BY_SCORE}) FILTER (WHERE score >= threshold) AS sure_scores, "
    "list(label ORDER BY label_pos) FILTER (WHERE positive) AS plist FROM flagged GROUP BY example_id, model)"
)


def _pct(k: int) -> str:
    return f"CAST(CAST(round_even(sure_scores[{k}] * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


STORY = (
    "CASE WHEN len(sure) >= 2 THEN "
    + _HEADLINE.format(x="sure[1]")
    + f" || ' lead the narrative (' || {_pct(1)} || '), with a ' || "
    + _TONE.format(x="sure[2]")
    + f" || ' undertone from ' || sure[2] || ' (' || {_pct(2)} || ').' "
    "WHEN len(sure) = 1 THEN "
    + _HEADLINE.format(x="sure[1]")
    + " || ' set a ' || "
    + _TONE.format(x="sure[1]")
    + f" || ' tone at ' || {_pct(1)} || '.' "
    "WHEN len(plist) >= 1 THEN "
    + _HEADLINE.format(x="plist[1]")
    + " || ' emerge despite muted probability scores.' "
    "ELSE 'Emotional signals stay below all configured thresholds.' END"
)

_LABELLED = (
    "ex AS (SELECT d.doc_id AS id, d.text, quality, toxic, CASE WHEN quality > 0 THEN 'quality' "
    "WHEN toxic > 0 THEN 'toxic' ELSE 'neutral' END AS primary_label FROM documents d JOIN labels USING (doc_id)),\n"
    "exr AS (SELECT *, percent_rank() OVER (PARTITION BY primary_label ORDER BY md5('42:' || id), id) AS rnk FROM ex),\n"
    f"exs AS (SELECT id, text, quality, toxic, {_split_case('rnk')} AS split FROM exr)"
)
_QUOTED = ", ".join(f'"{c}"' for c in LABELS)
TRAIN_TOKENS = "ttok AS (SELECT doc_id, t FROM tok JOIN exs ON exs.id = tok.doc_id WHERE split = 'train')"


def _hash_split(key: str) -> str:
    digest = f"substr(md5('42:' || {key}), 1, 8)"
    return (
        f"CASE WHEN {digest} < '{round(0.7 * 16**8):08x}' THEN 'train' "
        f"WHEN {digest} < '{round((0.7 + 0.15) * 16**8):08x}' THEN 'validation' ELSE 'test' END"
    )


def _idf(total: str) -> str:
    return f"ln(({total} + 1)::DOUBLE / (documents + 1)::DOUBLE)"


def statements() -> dict[str, str]:
    """SQL per query name."""
    sql: dict[str, str] = {}
    fine = ", ".join(FINE)
    sql["csv_shard_union"] = with_(ANNOTATIONS) + (
        f"SELECT CAST(id AS VARCHAR) AS id, text, example_very_unclear, {fine} FROM annotations"
    )
    sql["lexicon_tsv_scan"] = with_(WORDS, EMOTION) + "SELECT term, emotion FROM emotion"
    sql["vad_scan_normalized"] = with_(WORDS, VAD) + "SELECT * FROM vad"
    sql["filter_unclear"] = with_(ANNOTATIONS, CLEANED) + "SELECT id, rater FROM cleaned"
    sql["rater_max"] = with_(*CHAIN[:3]) + f"SELECT id, text, {fine} FROM collapsed"
    sql["taxonomy_projection"] = with_(*CHAIN[:4]) + f"SELECT id, text, {_QUOTED} FROM coarse"
    sql["primary_label"] = with_(*CHAIN[:5]) + "SELECT id, primary_label FROM prim"
    sql["label_array"] = with_(*CHAIN[:4]) + " UNION ALL ".join(
        f"SELECT id, {i}::INTEGER AS label_pos, \"{c}\" AS value FROM coarse" for i, c in enumerate(LABELS)
    )
    sql["prepared_examples"] = with_(*CHAIN[:4]) + (
        f"SELECT md5('false:' || length(CAST(id AS VARCHAR)) || ':' || id || ':false:' || length(text) || ':' || text) "
        f"AS example_id, text, {_QUOTED} FROM coarse"
    )
    sql["stratified_split"] = with_(*CHAIN) + "SELECT id, primary_label, split FROM splits"
    sql["stratified_split_bucketed"] = with_(*CHAIN[:6]) + (
        f"SELECT id, primary_label, rnk AS rank, {_split_case('rnk')} AS split FROM ranked"
    )
    sql["hash_split"] = f"SELECT doc_id, {_hash_split('doc_id')} AS split FROM documents"
    sql["hash_sample"] = (
        f"SELECT doc_id, lang FROM documents WHERE substr(md5('42:' || doc_id), 1, 8) < '{round(0.25 * 16**8):08x}'"
    )
    sql["split_counts"] = with_(*CHAIN) + 'SELECT split, primary_label, count(*) AS "rows" FROM splits GROUP BY ALL'
    sql["sample_rows"] = with_(*CHAIN) + (
        f"SELECT text, {_QUOTED} FROM splits WHERE split = 'test' ORDER BY md5('42:' || id), id LIMIT 15"
    )

    sql["tokens"] = (
        "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ') AS tokens FROM documents"
    )
    sql["filtered_tokens"] = with_(TOKENS) + "SELECT doc_id, array_to_string(t, ' ') AS tokens FROM tok"
    sql["ngrams"] = with_(TOKENS) + " UNION ALL ".join(
        f"SELECT doc_id, {n}::INTEGER AS n, len({grams(n)})::INTEGER AS size, array_to_string({grams(n)}, '|') AS grams FROM tok"
        for n in (2, 3)
    )
    sql["linguistic_features"] = with_(TOKENS, STYLE_BASE) + (
        "SELECT doc_id, " + ", ".join(style_columns(False)) + " FROM sty"
    )
    sql["linguistic_features_raw_case"] = with_(TOKENS, STYLE_BASE) + (
        "SELECT doc_id, " + ", ".join(style_columns(True)) + " FROM sty"
    )
    sql["lexicon_term_sets"] = with_(WORDS, EMOTION) + (
        "SELECT term, array_to_string(list(emotion ORDER BY emotion), ',') AS emotions FROM emotion GROUP BY term"
    )
    sql["lexicon_features"] = with_(TOKENS, WORDS, EMOTION, FLAGS, TOKEN_ROWS, LEX_SUMS) + (
        "SELECT doc_id, " + ", ".join(LEX_COLUMNS) + " FROM lex"
    )
    sql["vad_features"] = with_(TOKENS, WORDS, VAD, TOKEN_ROWS, VAD_SUMS) + (
        "SELECT doc_id, " + ", ".join(VAD_COLUMNS) + " FROM vs"
    )
    for n in (1, 2, 3):
        sql[f"vocabulary_{n}gram"] = with_(TOKENS, gram_rows(n), *vocabulary(n)) + (
            f'SELECT term, occurrences, documents, "index"::INTEGER AS "index" FROM v{n}'
        )
    every = [TOKENS] + [part for n in (1, 2, 3) for part in (gram_rows(n), *vocabulary(n))]
    total = "(SELECT count(*) FROM documents)"
    sql["idf_weights"] = with_(*every) + " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS n, term, round({_idf(total)}, 6) AS idf FROM v{n}" for n in (1, 2, 3)
    )
    sql["tfidf_long"] = with_(TOKENS, gram_rows(1), *vocabulary(1)) + (
        f"SELECT doc_id, term, count(*)::DOUBLE AS tf, round(count(*) * any_value({_idf(total)}), 6) AS tfidf "
        "FROM g1 JOIN v1 USING (term) GROUP BY doc_id, term"
    )
    train_parts = [_LABELLED, TOKENS, TRAIN_TOKENS]
    for n in (1, 2, 3):
        train_parts += [gram_rows(n, "ttok"), *vocabulary(n)]
    fixed = len(LEX_COLUMNS) + len(VAD_COLUMNS) + len(STYLE_FEATURES)
    sql["feature_dims"] = with_(*train_parts) + (
        " UNION ALL ".join(f"SELECT 'tfidf_{n}gram' AS block, count(*) AS dims FROM v{n}" for n in (1, 2, 3))
        + f" UNION ALL SELECT 'lexicon', {len(LEX_COLUMNS)} UNION ALL SELECT 'vad', {len(VAD_COLUMNS)}"
        + f" UNION ALL SELECT 'linguistic', {len(STYLE_FEATURES)} UNION ALL SELECT 'features', {fixed} "
        + " ".join(f"+ (SELECT count(*) FROM v{n})" for n in (1, 2, 3))
    )
    train_total = "(SELECT count(*) FROM ttok)"
    sums = []
    for n in (1, 2, 3):
        sums += [
            gram_rows(n, "ltok", f"lg{n}"),
            f"s{n} AS (SELECT doc_id, sum({_idf(train_total)}) AS s FROM lg{n} JOIN v{n} USING (term) GROUP BY doc_id)",
        ]
    sql["feature_table"] = with_(
        *train_parts,
        "ltok AS (SELECT tok.* FROM tok JOIN exs ON exs.id = tok.doc_id)",
        *sums, WORDS, EMOTION, FLAGS, VAD, TOKEN_ROWS, LEX_SUMS, VAD_SUMS, STYLE_BASE,
        "lexf AS (SELECT doc_id, " + ", ".join(LEX_COLUMNS) + " FROM lex)",
        "vadf AS (SELECT doc_id, " + ", ".join(VAD_COLUMNS) + " FROM vs)",
        "styf AS (SELECT doc_id, " + ", ".join(style_columns(False)) + " FROM sty)",
    ) + (
        "SELECT exs.id AS example_id, split, "
        + ", ".join(f"round(coalesce(s{n}.s, 0), 5) AS tfidf_{n}gram_sum" for n in (1, 2, 3))
        + ", lexf.* EXCLUDE (doc_id), vadf.* EXCLUDE (doc_id), styf.* EXCLUDE (doc_id) FROM exs "
        + " ".join(f"LEFT JOIN s{n} ON s{n}.doc_id = exs.id" for n in (1, 2, 3))
        + " JOIN lexf ON lexf.doc_id = exs.id JOIN vadf ON vadf.doc_id = exs.id JOIN styf ON styf.doc_id = exs.id"
    )
    # The same for all documents: the terms are those of the train rows, the split is NULL without a label.
    of_labelled = "ltok AS (SELECT tok.* FROM tok JOIN exs ON exs.id = tok.doc_id)"
    every_document = "(SELECT d.doc_id AS id, split FROM documents d LEFT JOIN exs ON exs.id = d.doc_id) AS exs"
    shared, _, last = sql["feature_table"].rpartition("SELECT exs.id AS example_id")
    sql["feature_table_all"] = (
        shared.replace(of_labelled, "ltok AS (SELECT * FROM tok)")
        + "SELECT exs.id AS example_id"
        + last.replace(" FROM exs ", f" FROM {every_document} ")
    )
    sql["feature_table"] = sql["feature_model_roundtrip_all"] = sql["feature_table_all"]
    sql["tfidf_long_all"] = with_(*every) + " UNION ALL ".join(
        f"SELECT doc_id, {n}::INTEGER AS n, term, count(*)::DOUBLE AS tf, "
        f"round(count(*) * any_value({_idf(total)}), 6) AS tfidf FROM g{n} JOIN v{n} USING (term) GROUP BY doc_id, term"
        for n in (1, 2, 3)
    )
    named = [("lexicon", LEX_COLUMNS), ("vad", VAD_COLUMNS), ("linguistic", style_columns(False))]
    ordered = [name for _, columns in named for name in _names(columns)]
    before = "0"
    vector = []
    for n in (1, 2, 3):
        vector.append(
            f"SELECT doc_id, (any_value(\"index\") + {before})::INTEGER AS place, 'tfidf_{n}gram_' || any_value(\"index\") AS name, "
            f"round(count(*) * any_value({_idf(train_total)}), 5) AS value FROM g{n}_all JOIN v{n} USING (term) GROUP BY doc_id, term"
        )
        before += f" + (SELECT count(*) FROM v{n})"
    places = ", ".join(f"('{name}', {i})" for i, name in enumerate(ordered))
    vector.append(
        f"SELECT doc_id, (p.pos + {before})::INTEGER AS place, name, round(value, 6) AS value FROM "
        "(UNPIVOT wide ON * EXCLUDE (doc_id) INTO NAME name VALUE value) "
        f"JOIN (VALUES {places}) AS p(name, pos) USING (name)"
    )
    sql["assembled_vector"] = with_(
        *train_parts, *[gram_rows(n, "tok", f"g{n}_all") for n in (1, 2, 3)],
        WORDS, EMOTION, FLAGS, VAD, TOKEN_ROWS, LEX_SUMS, VAD_SUMS, STYLE_BASE,
        "lexf AS (SELECT doc_id, " + ", ".join(LEX_EXACT) + " FROM lex)",
        "vadf AS (SELECT doc_id, " + ", ".join(VAD_EXACT) + " FROM vs)",
        "styf AS (SELECT doc_id, " + ", ".join(style_columns(False, exact=True)) + " FROM sty)",
        "wide AS (SELECT doc_id, " + ", ".join(f"{name}::DOUBLE AS {name}" for name in ordered)
        + " FROM lexf JOIN vadf USING (doc_id) JOIN styf USING (doc_id))",
        "vec AS (" + " UNION ALL ".join(vector) + ")",
    ) + "SELECT doc_id AS example_id, place, name, value FROM vec WHERE value != 0"
    scalars = [f"greatest({name}, 0.0::DOUBLE) AS {name}" for name in _names(LEX_COLUMNS)]
    scalars += _names(VAD_COLUMNS) + STYLE_FEATURES
    size = f"({fixed} + " + " + ".join(f"(SELECT count(*) FROM v{n})" for n in (1, 2, 3)) + ")"
    sql["scores_bayes"] = with_(
        *train_parts,
        "ltok AS (SELECT tok.* FROM tok JOIN exs ON exs.id = tok.doc_id)",
        *[gram_rows(n, "ltok", f"lg{n}") for n in (1, 2, 3)],
        WORDS, EMOTION, FLAGS, VAD, TOKEN_ROWS, LEX_SUMS, VAD_SUMS, STYLE_BASE,
        "lexf AS (SELECT doc_id, " + ", ".join(LEX_EXACT) + " FROM lex)",
        "vadf AS (SELECT doc_id, " + ", ".join(VAD_EXACT) + " FROM vs)",
        "styf AS (SELECT doc_id, " + ", ".join(style_columns(False, exact=True)) + " FROM sty)",
        "scal AS (SELECT doc_id, " + ", ".join(scalars) + " FROM ltok JOIN lexf USING (doc_id) "
        "JOIN vadf USING (doc_id) JOIN styf USING (doc_id))",
        # (document, feature, value) with every non-zero feature value
        "fv AS ("
        + " UNION ALL ".join(
            f"SELECT doc_id, '{n}:' || term AS f, count(*) * any_value({_idf(train_total)}) AS x "
            f"FROM lg{n} JOIN v{n} USING (term) GROUP BY doc_id, term"
            for n in (1, 2, 3)
        )
        + " UNION ALL SELECT doc_id, f, x FROM (UNPIVOT scal ON * EXCLUDE (doc_id) INTO NAME f VALUE x))",
        "marks AS (SELECT id AS doc_id, split, 'quality' AS label, 0 AS label_pos, quality AS y FROM exs "
        "UNION ALL SELECT id, split, 'toxic', 1, toxic FROM exs)",
        "sums AS (SELECT label, y AS class, f, sum(x) AS s FROM fv JOIN marks USING (doc_id) "
        "WHERE split = 'train' GROUP BY ALL)",
        "cls AS (SELECT label, y AS class, count(*) AS n FROM marks WHERE split = 'train' GROUP BY ALL)",
        f"prior AS (SELECT cls.label, cls.class, ln(n + 1.0::DOUBLE) - ln((SELECT sum(n) FROM cls c WHERE c.label = cls.label) "
        f"+ 2.0::DOUBLE) AS pi, ln((SELECT sum(s) FROM sums WHERE sums.label = cls.label AND sums.class = cls.class) "
        f"+ {size}::DOUBLE) AS base FROM cls)",
        # a feature without any training value in a class adds ln(1) = 0 to the first sum
        "hits AS (SELECT doc_id, label, class, sum(x * ln(s + 1.0::DOUBLE)) AS a FROM fv JOIN sums USING (f) GROUP BY ALL)",
        "whole AS (SELECT doc_id, sum(x) AS total FROM fv GROUP BY doc_id)",
        "raw AS (SELECT m.doc_id, m.split, m.label, m.label_pos, m.y, p.class, "
        "p.pi + coalesce(h.a, 0) - coalesce(w.total, 0) * p.base AS v FROM marks m JOIN prior p ON p.label = m.label "
        "LEFT JOIN hits h ON h.doc_id = m.doc_id AND h.label = m.label AND h.class = p.class "
        "LEFT JOIN whole w ON w.doc_id = m.doc_id)",
        "pair AS (SELECT doc_id, split, label, label_pos, y, max(v) FILTER (WHERE class = 0) AS v0, "
        "max(v) FILTER (WHERE class = 1) AS v1 FROM raw GROUP BY ALL)",
    ) + (
        "SELECT doc_id AS example_id, split, 'naive_bayes' AS model, label, label_pos::INTEGER AS label_pos, y::DOUBLE AS y, "
        "round(CASE WHEN v0 - v1 > 700 THEN 0.0 ELSE 1.0 / (1.0 + exp(v0 - v1)) END, 6)::DOUBLE AS score, "
        "CASE WHEN v1 > v0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pred, round(v1, 4)::DOUBLE AS raw FROM pair"
    )
    sql["clip_non_negative"] = with_(TOKENS, WORDS, EMOTION, FLAGS, TOKEN_ROWS, LEX_SUMS) + (
        "SELECT doc_id, lex_dominant_index AS raw_index, greatest(lex_dominant_index, 0.0)::DOUBLE AS lex_dominant_index, "
        "lex_total_matches FROM (SELECT doc_id, " + ", ".join(LEX_COLUMNS) + " FROM lex)"
    )
    sql["naive_bayes_parameters"] = with_(
        _LABELLED, TOKENS,
        "etok AS (SELECT doc_id, t, quality, toxic FROM tok JOIN exs ON exs.id = tok.doc_id WHERE split = 'train')",
        "g1 AS (SELECT doc_id, unnest(t) AS term FROM etok)",
        *vocabulary(1),
        "marks AS (SELECT id AS doc_id, 'quality' AS label, quality::INTEGER AS class FROM exs "
        "WHERE split = 'train' UNION ALL SELECT id, 'toxic', toxic::INTEGER FROM exs WHERE split = 'train')",
        "cnt AS (SELECT label, class, term, count(*) AS s FROM g1 JOIN v1 USING (term) JOIN marks USING (doc_id) GROUP BY ALL)",
        "tot AS (SELECT label, class, sum(s) AS cs FROM cnt GROUP BY ALL)",
        "cls AS (SELECT label, class, count(*) AS n FROM marks GROUP BY ALL)",
        "al AS (SELECT label, sum(n) AS a, count(*) AS k FROM cls GROUP BY label)",
    ) + (
        "SELECT cls.label, cls.class, v1.term, "
        "round(ln(coalesce(s, 0) + 1.0::DOUBLE) - ln(cs + (SELECT count(*) FROM v1)::DOUBLE), 6) AS theta, "
        "round(ln(n + 1.0::DOUBLE) - ln(a + k::DOUBLE), 6) AS pi "
        "FROM v1 CROSS JOIN cls JOIN tot ON tot.label = cls.label AND tot.class = cls.class "
        "JOIN al ON al.label = cls.label "
        "LEFT JOIN cnt ON cnt.label = cls.label AND cnt.class = cls.class AND cnt.term = v1.term"
    )

    score_columns = "example_id, split, model, label, label_pos, y, score, pred"
    sql["prediction_join"] = with_(*CHAIN, SCORES, _pivoted(BASE_MODELS)) + (
        "SELECT * FROM joined"
    )
    sql["prediction_join_by_text"] = with_(*CHAIN, SCORES, _pivoted(BASE_MODELS)) + (
        "SELECT md5(text) AS text_digest, joined.* EXCLUDE (example_id) FROM joined "
        "JOIN (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) ON doc_id = example_id"
    )
    sql["majority_vote"] = with_(*WITH_VOTES) + f"SELECT {score_columns} FROM votes"
    sql["threshold_grid"] = with_(*WITH_VOTES, GRID) + (
        f"SELECT model, label, threshold, tp, fp, fn, {_ROUNDED} FROM grid"
    )
    sql["best_thresholds"] = with_(*WITH_VOTES, GRID) + (
        f"SELECT model, label, threshold, tp, fp, fn, {_ROUNDED} FROM best"
    )
    sql["tuned_thresholds"] = with_(*WITH_VOTES, GRID, TUNED) + "SELECT model, label, threshold FROM tuned"
    sql["resolved_thresholds"] = with_(*WITH_VOTES, GRID, TUNED) + (
        "SELECT 'overrides' AS mode, model, label, CASE label WHEN 'fear' THEN 0.25::DOUBLE ELSE threshold END AS threshold "
        "FROM tuned UNION ALL SELECT 'base', model, label, CASE label WHEN 'fear' THEN 0.25 ELSE 0.6 END::DOUBLE FROM tuned"
    )
    sql["canonical_predictions"] = with_(*DECIDED) + f"SELECT {score_columns}, threshold FROM canon"
    sql["prediction_columns"] = with_(*DECIDED) + (
        "SELECT example_id, split, model, "
        + ", ".join(
            f"max(CASE WHEN label = '{c}' THEN y END) AS \"{c}\", max(CASE WHEN label = '{c}' THEN pred END) AS pred_{c}"
            for c in LABELS
        )
        + " FROM canon GROUP BY example_id, split, model"
    )
    sql["prediction_texts"] = (
        f"SELECT p.*, text FROM ({sql['prediction_columns']}) p LEFT JOIN documents ON doc_id = example_id"
    )
    sql["confusion"] = with_(*DECIDED, CONFUSION) + "SELECT * FROM conf"
    sql["per_label_metrics"] = with_(*DECIDED, CONFUSION, PER_LABEL) + (
        f"SELECT model, split, label, support, {_ROUNDED} FROM pl"
    )
    sql["micro_macro_metrics"] = with_(*DECIDED, CONFUSION, PER_LABEL, MICRO) + (
        "SELECT model, split, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, "
        f"round({_ratio('2.0 * p * r', 'p + r')}, 6) AS micro_f1, round(mp, 6) AS macro_precision, "
        "round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1 FROM mic2"
    )
    sql["hamming_loss"] = with_(*DECIDED) + (
        "SELECT model, split, round(avg(abs(y - pred)), 6) AS hamming_loss FROM canon GROUP BY ALL"
    )
    sql["subset_accuracy"] = with_(*DECIDED) + (
        "SELECT model, split, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS subset_accuracy FROM "
        "(SELECT model, split, example_id, bool_and(y = pred) AS ok FROM canon GROUP BY ALL) GROUP BY model, split"
    )
    sql["evaluation_summary"] = with_(*DECIDED, CONFUSION, PER_LABEL, MICRO) + (
        "SELECT mic2.model, mic2.split, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, "
        f"round({_ratio('2.0 * p * r', 'p + r')}, 6) AS micro_f1, round(mp, 6) AS macro_precision, "
        "round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, "
        "round(h.v, 6) AS hamming_loss, round(a.v, 6) AS subset_accuracy FROM mic2 "
        "JOIN (SELECT model, split, avg(abs(y - pred)) AS v FROM canon GROUP BY ALL) h "
        "ON h.model = mic2.model AND h.split = mic2.split "
        "JOIN (SELECT model, split, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS v FROM (SELECT model, split, example_id, "
        "bool_and(y = pred) AS ok FROM canon GROUP BY ALL) GROUP BY model, split) a "
        "ON a.model = mic2.model AND a.split = mic2.split"
    )
    sql["top_labels"] = with_(*DECIDED, SUMMARIES) + (
        "SELECT example_id, model, array_to_string(coalesce(ranked_labels, plist, []::VARCHAR[])[1:5], ',') AS top_labels FROM summ"
    )
    sql["positive_labels"] = with_(*DECIDED, SUMMARIES) + "SELECT example_id, model, positives AS positive_labels FROM summ"
    sql["story"] = with_(*DECIDED, SUMMARIES) + f"SELECT example_id, model, {STORY} AS story FROM summ"

    sql["feature_model_roundtrip"] = sql["feature_table"]
    sql["label_models_roundtrip"] = sql["scores_bayes"]
    sql["resume_roundtrip"] = sql["scores_bayes"]
    sql["split_table_roundtrip"] = sql["stratified_split"]
    sql["scores_roundtrip"] = with_(*CHAIN, SCORES) + f"SELECT {score_columns} FROM scores"
    sql["thresholds_roundtrip"] = sql["tuned_thresholds"]
    sql["metrics_json_roundtrip"] = with_(*DECIDED, CONFUSION, PER_LABEL) + (
        f"SELECT model, split AS dataset, label, support, {_ROUNDED} FROM pl"
    )
    sql["sample_texts_roundtrip"] = with_(*CHAIN) + (
        "SELECT text FROM splits WHERE split = 'test' ORDER BY md5('42:' || id), id LIMIT 15"
    )
    return sql
