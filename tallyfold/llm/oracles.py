"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from tallyfold.llm.secrets import ACCESS, ASSIGN, ASSIGN_LEAST, CLASSES, HEX, PLACEHOLDERS, UUID


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, pattern: str, keep: str = "true") -> str:
    """doc_id, m, start, end of every match in t, by the lengths of the matches and of the pieces between them."""
    p = _text(pattern)
    return f"""{name}_cut as (select doc_id, regexp_extract_all(text, {p}, 0) as ms, string_split_regex(text, {p}) as gs from t where regexp_matches(text, {p})),
{name}_each as (select doc_id, generate_subscripts(ms, 1) as i, unnest(ms) as m, unnest(gs[1:len(ms)]) as g from {name}_cut),
{name}_at as (select doc_id, m, sum(length(g) + length(m)) over (partition by doc_id order by i) as stop from {name}_each),
{name} as (select doc_id, m, stop - length(m) as start, stop from {name}_at where {keep})"""


def _entropy(name: str, found: str, kind: str, rank: int, window: int, least: float) -> str:
    masked = "m"
    for word, cased in PLACEHOLDERS:
        masked = f"regexp_replace({masked}, '{word}', '{' ' * len(word)}', '{'g' if cased else 'gi'}')"
    ch = f"({window} - length(replace(w, ch, '')))"
    return f"""{name}_free as (select f.*, {masked} as x from {found} f where not exists (select 1 from base b where b.doc_id = f.doc_id and b.start <= f.start and f.stop <= b.stop)),
{name}_moves as (select doc_id, m, start, x, unnest(range(0, length(x) - {window} + 1)) as i from {name}_free),
{name}_wins as (select doc_id, m, start, i, substring(x, i + 1, {window}) as w from {name}_moves),
{name}_hot as (select doc_id, m, start, i from {name}_wins where not contains(w, ' ') and list_sum(list_transform(list_distinct(string_split(w, '')), lambda ch: {ch} * log2({ch}))) <= (log2({window}) - {least}) * {window} + 1e-9),
{name}_spans as (select doc_id, m, start, min(i) as lo, max(i) + {window} as hi from {name}_hot group by 1, 2, 3),
{name} as (select doc_id, start + lo as start, {rank} as rank, start + hi as stop, '{kind}' as kind from {name}_spans where not regexp_matches(m, {_text(UUID)}) and regexp_matches(substring(m, lo + 1, hi - lo), '[0-9]') and regexp_matches(substring(m, lo + 1, hi - lo), '[A-Za-z]'))"""


def _secrets() -> str:
    (b64, b64_pattern, _, b64_window, b64_least), (hexa, _, _, hexa_window, hexa_least) = CLASSES
    # The second class has a look-behind, which this dialect lacks: a whole run of letters and digits that is one.
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents),
{_matches('m_assign', ASSIGN, f"length(regexp_extract(m, {_text(ASSIGN)}, 2)) >= {ASSIGN_LEAST}")},
{_matches('m_access', ACCESS)},
{_matches('m_hex', HEX)},
base as (select doc_id, start, 0 as rank, stop, 'assign' as kind from m_assign union all select doc_id, start, 1, stop, 'access' from m_access union all select doc_id, start, 2, stop, 'hex' from m_hex),
{_matches('c_long', b64_pattern)},
{_matches('c_runs', '[A-Za-z0-9]+', "regexp_full_match(m, '[0-9A-Fa-f]{16,}')")},
{_entropy('e_long', 'c_long', b64, 3, b64_window, b64_least)},
{_entropy('e_runs', 'c_runs', hexa, 4, hexa_window, hexa_least)},
every as (select * from base union all select * from e_long union all select * from e_runs),
told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank, stop) filter (rank < 3) as base_text,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank, stop) as spans from every group by 1)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_text, '')) as base_sha256, coalesce(spans, '') as spans from t left join told using (doc_id)"""


_SUBSTRINGS = """with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, unnest(range(0, n - 99)) as p, unnest(list_transform(range(0, n - 99), lambda i: md5(substring(h, 2 * i + 1, 200)))) as s from t where n >= 100),
ranked as (select doc_id, p, row_number() over (partition by s order by doc_id, p) as nth from starts),
gone as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from ranked where nth > 1),
marked as (select doc_id, p, sum(case when before is null or p > before + 100 then 1 else 0 end) over (partition by doc_id order by p) as island from gone),
spans as (select doc_id, min(p) as a, max(p) + 100 as b from marked group by doc_id, island),
bounds as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
pieces as (select doc_id, a, substring(h, 2 * before + 1, 2 * (a - before)) as piece from bounds join t using (doc_id)
  union all select doc_id, n, substring(h, 2 * coalesce(last_b, 0) + 1) from t left join (select doc_id, max(b) as last_b from spans group by 1) using (doc_id)),
kept as (select doc_id, string_agg(piece, '' order by a) as k from pieces group by 1),
sums as (select doc_id, sum(b - a) as removed, count(*) as runs from spans group by 1)
select t.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(runs, 0) as n_spans, sha256(unhex(k)) as kept_sha256 from t join kept using (doc_id) left join sums using (doc_id)"""

ORACLES = {"op6_suffix": _SUBSTRINGS, "op10_secrets": _secrets()}
