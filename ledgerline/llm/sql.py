"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from ledgerline.llm.quality_rules import BOILERPLATE

_WORDS = r"""
    words as (
        select doc_id, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
        from documents)"""


def _times(pattern: str) -> str:
    return f"len(regexp_extract_all(line, '{pattern}'))"


_LINE_RULES = r"""
    with {words},
    windows as (select doc_id, i, ws[i:i + 4] as g from words, unnest(range(1, len(ws) - 3)) as t(i)),
    repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
    covered as (
        select doc_id, count(distinct i + k) as n from repeated, unnest(range(5)) as t(k) group by doc_id),
    lines as (
        select doc_id, line, count(*) as n,
               length(regexp_replace(line, '[ 	-
]+', '', 'g')) as chars,
               {n_bars} as bars, {n_words} as n_words
        from (select doc_id, unnest(string_split(text, chr(10))) as line from words)
        where regexp_matches(line, '[^ 	-
]') group by doc_id, line),
    judged as (
        select *, {n_symbols} * 10 > chars or {n_doubled} >= 3
                  or (bars >= 2 and bars * 5 >= n_words - bars)
                  or (n_words >= 5 and {n_capitals} * 10 > chars * 6)
                  or regexp_matches(lower(line), '{phrases}') as fails
        from lines),
    per_text as (
        select doc_id, sum(n) - count(*) as n_dup_lines,
               coalesce(sum(chars) filter (not fails), 0) as clean_chars
        from judged group by doc_id),
    counted as (
        select doc_id, cast(len(ws) as bigint) as n_words,
               cast(length(array_to_string(ws, '')) as bigint) as word_chars,
               cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
               cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
               cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
               cast(length(array_to_string(ws, '')) - coalesce(clean_chars, 0) as bigint) as lost_chars
        from words left join per_text using (doc_id) left join covered c using (doc_id))
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
           not base_failed and 100 * lost_chars <= 30 * word_chars as kept
    from counted""".format(
    words=_WORDS.strip(),
    n_bars=_times(r"[\x20\x09-\x0D][|»›·•]+(?:[\x20\x09-\x0D]|$)"),
    n_words=_times(r"[^\x20\x09-\x0D]+"),
    n_symbols=_times(r"[#*$%&<>=^~_\\{}]"),
    n_doubled=_times(r"(?:!!|\?\?|\.\.\.)(?:[\x20\x09-\x0D]|$)"),
    n_capitals=_times(r"\p{Lu}"),
    phrases="|".join(BOILERPLATE),
)

_GROUPS = f"""
    with recursive {_WORDS.replace("coalesce(text, '') as text", "text").replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").strip()},
    shingles as (
        select doc_id, ws[i:i + 4] as g from words, unnest(range(1, greatest(len(ws) - 3, 2))) as t(i)
        where len(ws) > 0 group by all),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (
        select a.doc_id as x, b.doc_id as y, count(*) as n
        from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (
        select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
        where 100 * shared.n >= 80 * (a.n + b.n - shared.n)),
    reached as (select doc_id as x, doc_id as y from words union select r.x, l.y from reached r join links l on l.x = r.y)
    select x as doc_id, coalesce(n, 0) as n_shingles, min(y) as component_id
    from reached left join sizes on sizes.doc_id = x group by x, n"""

_WINDOW_DEDUP = f"""
    with {_WORDS.strip()},
    windows as (select doc_id, i, ws[i:i + 34] as g from words, unnest(range(1, len(ws) - 33)) as t(i)),
    repeated as (select doc_id, i from windows qualify count(*) over (partition by g) > 1),
    gone as (select distinct doc_id, i + k as i from repeated, unnest(range(35)) as t(k)),
    placed as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from words),
    kept as (
        select doc_id, count(*) as n, string_agg(w, ' ' order by i) as text
        from placed anti join gone using (doc_id, i) group by doc_id)
    select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
           sha256(coalesce(kept.text, '')) as kept_sha256
    from words left join kept using (doc_id)"""

_SUBSTRING_DEDUP = """
    with bytes as (
        select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
    windows as (
        select doc_id, i, substring(h, 2 * i - 1, 200) as g from bytes, unnest(range(1, n - 98)) as t(i)),
    later as (
        select doc_id, i from windows qualify row_number() over (partition by g order by doc_id, i) > 1),
    gone as (
        select distinct doc_id, i + k as i from later, unnest(range(100)) as t(k)),
    placed as (
        select doc_id, i, substring(h, 2 * i - 1, 2) as b from bytes, unnest(range(1, n + 1)) as t(i)),
    kept as (
        select doc_id, count(*) as n, string_agg(b, '' order by i) as h
        from placed anti join gone using (doc_id, i) group by doc_id),
    spans as (
        select g.doc_id, count(*) as n from gone g
        anti join gone before on before.doc_id = g.doc_id and before.i = g.i - 1 group by g.doc_id)
    select doc_id, cast(bytes.n as bigint) as n_bytes, cast(bytes.n - coalesce(kept.n, 0) as bigint) as n_removed,
           cast(coalesce(spans.n, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
    from bytes left join kept using (doc_id) left join spans using (doc_id)"""

def _vector_codes(rounds: int = 2) -> str:
    """Codebooks refined round by round, every part held against every entry."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
    pairs{r} as (
        select id, p, x, e, cast(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) as bigint) as d
        from parts join book{r} using (p)),
    near{r} as materialized (
        select id, p, any_value(x) as x, arg_min(e, (d, e)) as e, min(d) as d from pairs{r} group by id, p),"""
        if r < rounds:
            steps += f"""
    sums{r} as (
        select p, e, i, sum(x[i]) as total, count(*) as n
        from near{r}, unnest(range(1, len(x) + 1)) as t(i) group by p, e, i),
    means{r} as (
        select p, e, list(cast(floor(cast(total as double) / n) as bigint) order by i) as y from sums{r} group by p, e),
    book{r + 1} as materialized (
        select p, e, coalesce(m.y, b.y) as y from book{r} b left join means{r} m using (p, e)),"""
    return f"""
    with kept as (
        select vec_id, label, row_number() over (order by vec_id) as id,
               list_transform(embedding, lambda v: cast(floor(256 * cast(v as double)) as bigint)) as v
        from embeddings
        where len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
    parts as materialized (
        select id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x
        from kept, unnest(range(16)) as t(p)),
    book0 as materialized (select p, id - 1 as e, x as y from parts where id <= 64),{steps}
    sha as (
        select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}),
    coded as (
        select id, string_agg(format('{{:02x}}', e), '' order by p) as code, cast(sum(d) as bigint) as error
        from near{rounds} group by id)
    select vec_id, code, error,
           cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
    from coded join kept using (id), sha"""


ORACLE: dict[str, str] = {
    "op1_ngram_join": _GROUPS,
    "op7_line_rules": _LINE_RULES,
    "op8_suffix_dedup": _SUBSTRING_DEDUP,
    "op10_window_dedup": _WINDOW_DEDUP,
    "op2_warc": """
        with held as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
            from pages
        ), keepers as (
            select payload_digest, max(page_id) as keeper from held where payload_bytes >= 1000 group by payload_digest
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> keeper then keeper end as refers_to
        from held left join keepers using (payload_digest)
    """,
    "op11_vector_codes": _vector_codes(),
}
