"""Joins and set operations between collections."""

from __future__ import annotations

from ..catalog import template
from ..plans.dialect import Dialect
from .answers import checked, evidence_claims
from .chunking import spans
from .retrieval import bm25, gold, ranked


@template("JOI03_anti_union")
def _anti(d: Dialect) -> str:
    return "select doc_id, 'chunk' as origin from documents where doc_id % 3 <> 0 union all select l.doc_id, 'metadata' from labels l left join (select doc_id from documents where doc_id % 3 <> 0) c on c.doc_id = l.doc_id where c.doc_id is null"


@template("JOI05_segments_around_frames")
def _segments(d: Dialect) -> str:
    """An event within an hour of a segment of ten minutes: both go by hours, the frame's own and those around it."""
    at, hour = d.seconds("ts"), "cast(floor(t / 3600) as bigint)"
    frames = f"(select event_id, user_id, t, bin from {d.unnest(chr(40) + 'select * from e where event_type = ' + d.text('click') + ') c', 'event_id, user_id, t', d.count_up(hour + ' - 2', hour + ' + 1'), 'bin')} u)"
    segments = f"(select *, {hour} as bin from e)"
    return f"""with e as (select event_id, user_id, event_type, {at} as t from events)
        select f.event_id, count(*) as n, {d.gather("s.event_type", "s.t, s.event_id", "' '")} as segments from {frames} f join {segments} s on s.user_id = f.user_id and s.bin = f.bin and s.t <= f.t + 3600 and s.t + 600 >= f.t - 3600 group by f.event_id"""


@template("JOI08_similar_lines")
def _lines(d: Dialect) -> str:
    """Pairs of queries that share 3-grams, blocked by them, with a Jaccard of 0.1 or more."""
    return f"""with g as (select item_id, item as gram from {d.unnest('benchmark', 'item_id', d.grams('lower(substr(text, 1, 60))'), 'item')} t),
        n as (select item_id, count(*) as n from g group by item_id)
        select a.item_id as a, b.item_id as b, round(cast(count(*) as double) / (max(x.n) + max(y.n) - count(*)), 6) as jaccard from g a join g b on a.gram = b.gram and a.item_id < b.item_id join n x on x.item_id = a.item_id join n y on y.item_id = b.item_id
        group by a.item_id, b.item_id having cast(count(*) as double) / (max(x.n) + max(y.n) - count(*)) >= 0.1"""


@template("JOI09_gold_in_top")
def _semi(d: Dialect) -> str:
    """The hits among each query's ten best that are gold."""
    return f"with {bm25(d)}, {ranked('top', 'bm')}, g as ({gold(d)}) select query_id, doc_id, cast(rk as int) as rank from top where exists (select 1 from g where g.query_id = top.query_id and g.doc_id = top.doc_id)"


@template("JOI10_claims_with_chunks")
def _claims(d: Dialect) -> str:
    """Claims of answers with the chunks that they cite, eight of an answer at most; unknown citations join nothing."""
    return f"""with {checked(d)}, {evidence_claims(d)}, cited as (select doc_id, place, claim, pos as cite_place, cite_id from {d.unnest('ev', 'doc_id, place, claim', 'cite_ids', 'cite_id')} t),
        chunks as (select source || '#' || doc_id as chunk_id, doc_id as chunk_doc, n_chars from documents)
        select doc_id, cast(k as int) as pair, claim, chunk_doc, n_chars from (select c.doc_id, claim, chunk_doc, n_chars, row_number() over (partition by c.doc_id order by place, cite_place) as k from cited c join chunks h on h.chunk_id = c.cite_id) r where k <= 8"""


@template("JOI11_neighbour_chunks")
def _neighbours(d: Dialect) -> str:
    if d.spark:
        return "select doc_id, preceding, following from prepared_beside"
    return "select doc_id, lag(doc_id) over (partition by source order by doc_id) as preceding, lead(doc_id) over (partition by source order by doc_id) as following from documents"


@template("CHK04_page_spans")
def _pages(d: Dialect) -> str:
    """Chunks by the pages that hold their first and last character, pages of 1,000 characters; the first page, or the
    last one, where none does."""
    return f"""with c as {spans(d)}, p as (select doc_id, pos as page, (pos - 1) * 1000 as first_char, pos * 1000 as end_char from {d.unnest('documents', 'doc_id', d.count_up('1', 'greatest(1, floor((n_chars + 999) / 1000))'), 'page_no')} t)
        select c.doc_id, c.start, coalesce(min(p.page), 1) as page_start, coalesce(max(case when c.start + 400 <= p.end_char then p.page end), max(z.last_page)) as page_end from c join (select doc_id, cast(greatest(1, floor((n_chars + 999) / 1000)) as bigint) as last_page from documents) z on z.doc_id = c.doc_id left join p on p.doc_id = c.doc_id and p.first_char < c.start + 400 and p.end_char > c.start group by c.doc_id, c.start"""


@template("SET02_intersection_coverage")
def _coverage(d: Dialect) -> str:
    return f"""with b as (select distinct item_id, item as term from {d.unnest('benchmark', 'item_id', d.long_tokens('text'), 'item')} t), x as (select distinct doc_id, item as term from {d.unnest('documents', 'doc_id', d.long_tokens('text'), 'item')} t)
        select item_id, doc_id, count(*) as shared from b join x on b.term = x.term group by item_id, doc_id having count(*) >= 3"""


@template("SET03_gram_jaccard")
def _jaccard(d: Dialect) -> str:
    shared, either = d.common("x", "y"), f"({d.size('x')} + {d.size('y')} - {d.common('x', 'y')})"
    return f"select conv_id, turn, case when a = b then 1.0e0 when {either} = 0 then 0.0e0 else round(cast({shared} as double) / {either}, 6) end as jaccard from (select c.conv_id, c.turn, c.text as a, n.text as b, {d.grams('c.text')} as x, {d.grams('n.text')} as y from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1) p"


@template("SET04_ordered_distinct")
def _distinct(d: Dialect) -> str:
    return "select conv_id, turn, role from (select conv_id, turn, role, row_number() over (partition by conv_id, lower(trim(role)) order by turn) as n from conversations) r where n = 1"


@template("SET05_invalid_citations")
def _invalid(d: Dialect) -> str:
    used = d.array("source", "'src0'", "'ghost' || (doc_id % 3)")
    return f"select doc_id, {d.join(d.without(used, d.array(*d.texts(*(f'src{i}' for i in range(15))))), chr(39) + ',' + chr(39))} as invalid from documents"


@template("SET06_decomposed_union")
def _decomposed(d: Dialect) -> str:
    return "select topic, doc_id, min(part) as part from (select cast(floor(l.doc_id / 100) as bigint) as topic, l.doc_id, 0 as part from labels l where quality = 1 union all select cast(floor(l.doc_id / 100) as bigint), l.doc_id, 1 from labels l where toxic = 0) u group by topic, doc_id"
