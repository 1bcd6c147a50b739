"""Chunking of texts by windows of tokens, sentences, paragraphs and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import builder, template
from ..plans.dialect import Dialect
from ..plans.ordered import running

# fixed values: window and overlap of tokens, and the limits of the semantic split
SIZE, OVERLAP = 256, 64
SIMILAR, LEAST_GROUP = 0.75, 2


def spans(d: Dialect) -> str:
    """Spans of 400 characters, 300 apart: (doc_id, start)."""
    return f"(select doc_id, item as start from {d.unnest('documents', 'doc_id', d.count_up('0', 'greatest(n_chars - 1, 0)', '300'), 'item')} t)"


@template("CHK01_token_windows")
def _windows(d: Dialect) -> str:
    n, step = d.size("w"), SIZE - OVERLAP
    starts = d.count_up("0", f"greatest({n} - 1, 0)", str(step))
    source = f"(select doc_id, {d.words('text')} as w from documents)"
    return f"select doc_id, s as start, md5({d.join(d.slice('w', 's + 1', str(SIZE)), chr(39) + ' ' + chr(39))}) as chunk, least({SIZE}, n - s) as tokens from {d.unnest(f'(select doc_id, w, {n} as n from {source} x) y', 'doc_id, w, n', starts, 's')} t where n > 0 and (s = 0 or s - {step} + {SIZE} < n)"


@template("CHK02_window_offsets")
def _offsets(d: Dialect) -> str:
    n, step = d.size("w"), SIZE - OVERLAP
    starts = d.count_up("0", f"greatest({n} - 1, 0)", str(step))
    source = f"(select doc_id, text, {d.words('text')} as w from documents)"
    chunk = d.join(d.slice("w", "s + 1", str(SIZE)), "' '")
    return f"select doc_id, s as start, char_start, case when char_start < 0 then 0 else char_start + n_chars end as char_end from (select doc_id, s, cast(instr(text, chunk) as bigint) - 1 as char_start, cast(length(chunk) as bigint) as n_chars from (select doc_id, text, s, {chunk} as chunk from {d.unnest(f'(select doc_id, text, w, {n} as n from {source} x) y', 'doc_id, text, w, n', starts, 's')} t where n > 0 and (s = 0 or s - {step} + {SIZE} < n)) c) e"


@builder("CHK05_page_offsets", "select source, doc_id, coalesce(cast(sum(n_chars + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding) as bigint), 0) as offset_ from documents")
def _pages(spark, get):
    found = running(get("documents").select("source", "doc_id", "n_chars"), ["source"], [F.asc("doc_id")], {"upto": F.col("n_chars").cast("bigint") + 2})
    return found.select("source", "doc_id", (F.col("upto") - F.col("n_chars") - 2).alias("offset_"))


@template("CHK08_semantic_split")
def _semantic(d: Dialect) -> str:
    """Runs of neighbouring vectors of a label; a similarity under the limit starts a new run; small runs are kept
    and marked, where they would be lost otherwise."""
    return f"""select label, run, count(*) as n, min(vec_id) as first_vec, count(*) < {LEAST_GROUP} as small from (select label, vec_id, cast(sum(case when s is null or s < {SIMILAR} then 1 else 0 end) over (partition by label order by vec_id rows between unbounded preceding and current row) as bigint) as run
        from (select label, vec_id, {d.dot('embedding', 'before')} as s from (select label, vec_id, embedding, lag(embedding) over (partition by label order by vec_id) as before from embeddings) l) g) r group by label, run"""


@template("CHK10_strategy")
def _strategy(d: Dialect) -> str:
    breaks = f"{d.size(d.split('text', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n'))} - 1"
    return f"select doc_id, case when {breaks} > 5 then 'paragraph' when {d.size(d.sentences('text'))} > 10 then 'semantic' else 'sentence' end as strategy from documents"


# fixed values: pages that a file must have more of, and the characters by which a line is told
HEADER_PAGES, HEADER_SHARE, HEADER_CHARS = 2, 0.5, 10


def without_headers(d: Dialect, pages: str, counted: str | None = None) -> str:
    """(file, page, text, header, footer): pages (file, page, text) without the line that begins, or ends, at least half
    of a file's pages that have one (two at least), the most frequent and of those the smallest. Lines are stripped
    first; a page's line goes if its first (for footers: last) ten characters agree with that line's. counted: a
    relation (file, kind, line, n, own) of the first (h) and last (f) lines, if n counts more than equal lines."""
    lines, strip = d.split("text", r"\n"), d.strip
    own = d.split(strip("text"), r"\n")
    n = HEADER_CHARS
    tail = lambda x: f"substr({x}, greatest(length({x}) - {n - 1}, 1))"
    starts = lambda x, y: f"substr({x}, 1, length({y})) = {y}"
    ends = lambda x, y: f"substr({x}, greatest(length({x}) - length({y}) + 1, 1)) = {y}"
    head, foot = f"substr(h.line, 1, {n})", tail("f.line")
    cut_head = f"h.line is not null and p.first_ <> '' and ({starts('p.first_', head)} or {starts('h.line', f'substr(p.first_, 1, {n})')})"
    cut_foot = f"f.line is not null and p.last_ <> '' and ({ends('p.last_', foot)} or {ends('f.line', tail('p.last_'))})"
    kept = d.join(d.slice("lines", "1 + b", f"greatest({d.size('lines')} - b - c, 0)"), "chr(10)")
    c = f"select file, kind, line, n, own from {counted} c_" if counted else "select file, kind, line, count(*) as n, count(*) as own from l group by file, kind, line"
    return f"""(with p as (select file, page, lines, {strip(d.at('lines', '1'))} as first_, {strip(d.at('lines', d.size('lines')))} as last_, {strip(d.at('own', '1'))} as top, {strip(d.at('own', d.size('own')))} as bottom from (select file, page, {lines} as lines, {own} as own from {pages} g) s),
        l as (select file, 'h' as kind, top as line from p where top <> '' union all select file, 'f', bottom from p where bottom <> ''), c as ({c}),
        w as (select file, kind, line, n, sum(own) over (partition by file, kind) as total, row_number() over (partition by file, kind order by n desc, line) as k from c), z as (select file, count(*) as pages from p group by file),
        best as (select w.file, kind, line from w join z on z.file = w.file where k = 1 and z.pages > {HEADER_PAGES} and n >= greatest(2, {HEADER_SHARE} * total)),
        o as (select p.file, p.page, lines, h.line as header, f.line as footer, case when {cut_head} then 1 else 0 end as b, case when {cut_foot} then 1 else 0 end as c from p left join best h on h.file = p.file and h.kind = 'h' left join best f on f.file = p.file and f.kind = 'f')
        select file, page, header, footer, {strip(kept)} as text from o)"""


def host_pages(d: Dialect, pages: str = "pages") -> str:
    """Lines of the web pages of a host, one tag a line, as a file's pages: (file, page, text)."""
    lines = d.sub("html", ">", "'>' || chr(10)")
    host = d.extract("url", r"^https?://(?:[^/]*\.)?([^./]+\.[^./]+)(?:/|$)", 1)
    return f"select {host} as file, page_id as page, {lines} as text from {pages}"


@template("CHK12_headers")
def _headers(d: Dialect) -> str:
    return f"select file, page, header, footer, md5(text) as text from {without_headers(d, f'({host_pages(d)})')} w"
