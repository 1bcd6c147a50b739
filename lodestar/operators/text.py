"""Scalar text operators: cleaning, tokenizing, estimates, citations, filters."""

from __future__ import annotations

from ..catalog import template
from ..plans.dialect import Dialect
from .retrieval import bm25, ranked

# fixed values: phrases, limits and names that define the results
ABSTAIN = ("insufficient context", "i don't know", "cannot answer", "not enough information", "no evidence", "unable to determine", "not found in the context")
ABSTAIN_GENERATOR = ("cannot answer", "cannot fully answer", "not provided in", "insufficient", "not enough", "unable to determine")
HEDGES = ("might be", "could be", "possibly", "perhaps", "it seems", "it appears", "i think", "probably", "may have", "likely", "uncertain")
LANGUAGES = (("en", "english"), ("hi", "hindi"), ("te", "telugu"), ("ta", "tamil"), ("kn", "kannada"), ("ml", "malayalam"), ("bn", "bengali"), ("mr", "marathi"), ("gu", "gujarati"), ("pa", "punjabi"), ("ur", "urdu"), ("ne", "nepali"), ("zh", "chinese"), ("ja", "japanese"), ("ko", "korean"), ("ar", "arabic"), ("de", "german"), ("fr", "french"), ("es", "spanish"), ("pt", "portuguese"), ("ru", "russian"), ("it", "italian"), ("nl", "dutch"), ("pl", "polish"))


def normalized(d: Dialect, x: str) -> str:
    """White space in a fixed order: soft hyphens, joined lines, line ends, blank lines, runs, ends."""
    x = f"replace({x}, chr(173), '')"
    x = f"replace({x}, '-' || chr(10), '')"
    x = d.sub(x, r"\r\n?", "chr(10)")
    x = d.sub(x, r"\n{3,}", "chr(10) || chr(10)")
    x = d.sub(x, r"[ \t]{2,}", "' '")
    return d.strip(x)


def scalar(name: str, columns, source: str = "documents", key: str = "doc_id", where=None):
    """Register a projection: columns(d) gives output names and expressions over the source."""

    @template(name)
    def sql(d: Dialect) -> str:
        out = ", ".join(f"{e} as {n}" for n, e in columns(d).items())
        src = source(d) if callable(source) else source
        return f"select {key}, {out} from {src}" + (f" where {where(d)}" if where else "")


def answers(d: Dialect) -> str:
    """Answers made of documents: some cite their source, some hedge, some abstain."""
    said = "case when doc_id % 11 = 0 then 'Insufficient context, cannot answer. ' when doc_id % 5 = 0 then 'It seems this is possibly so, and might be likely. ' else '' end"
    cited = "case when doc_id % 3 = 0 then '' when doc_id % 7 = 0 then ' [' || source || '#' || doc_id || '] [ghost#0]' else ' [' || source || '#' || doc_id || ']' end"
    return f"(select doc_id, source, lang, text, {said} || substr(text, 1, 60 + cast(doc_id % 7 as int) * 90) || {cited} || '. ' || substr(text, 200, 120) as answer, source || '#' || doc_id as cite from documents)"


# fixed values: what a context takes of a video's and of an audio's text, in characters
VIDEO_CHARS, AUDIO_CHARS = 600, 500


def modal(d: Dialect) -> str:
    """Documents as chunks of four modalities with the fields of each."""
    kind = "case doc_id % 4 when 0 then 'text' when 1 then 'image' when 2 then 'audio' else 'video' end"
    return f"(select doc_id, {kind} as modality, text as content, case when doc_id % 8 = 1 then '' else substr(text, 5) end as caption, case when doc_id % 3 = 0 then '  ' else substr(text, 30) end as ocr_text, case when doc_id % 5 = 0 then '' else substr(text, 60) end as transcript, source, n_chars from documents)"


def picked(d: Dialect) -> str:
    video = d.first("caption", "ocr_text", "transcript", "content")
    return f"case modality when 'image' then {d.first('caption', 'ocr_text', 'content')} when 'audio' then {d.first('transcript', 'content')} when 'video' then {video} else {d.first('content')} end"


scalar("TXT01_normalize_whitespace", lambda d: {"cleaned": normalized(d, "text")})
scalar("TXT02_query_preprocess", lambda d: {"query": d.join(d.slice(d.words("text"), "1", "512"), "' '")}, key="item_id", source="benchmark")
scalar("TXT03_query_tokenizer", lambda d: {"tokens": d.join(d.tokens("text"), "' '"), "n": d.size(d.tokens("text"))})
scalar("TXT04_index_tokenizer", lambda d: {"tokens": d.join(d.words("lower(text)"), "' '"), "n": d.size(d.words("text"))})
scalar("TXT05_sentences", lambda d: {"sentences": d.join(d.sentences("text"), "'|'"), "n": d.size(d.sentences("text"))})
scalar("TXT07_verifier_sentences", lambda d: {"sentences": d.join(d.slice(d.filter(d.sentences("text"), "t", "length(t) > 12"), "1", "8"), "'|'")})
scalar("TXT08_generator_sentences", lambda d: {"sentences": d.join(d.filter(d.sentences("text"), "t", "length(t) > 10"), "'|'")})
scalar("TXT09_token_estimate_words", lambda d: {"tokens": f"greatest(1, cast(floor({d.size(d.words('text'))} * 1.3) as bigint))"})
scalar("TXT10_token_estimate_chars", lambda d: {"tokens": "greatest(1, cast(floor(length(text) / 4) as bigint))"})
scalar("TXT11_whitespace_tokens", lambda d: {"tokens": d.size(d.words("text"))})
scalar("TXT12_content_pick_fusion", lambda d: {"picked": picked(d)}, source=modal)
scalar("TXT13_content_pick_index", lambda d: {"picked": f"case modality when 'image' then {d.first('ocr_text', 'caption')} when 'audio' then {d.first('transcript')} when 'video' then {d.first('transcript', 'caption', 'ocr_text')} else {d.first('content')} end", "meta_picked": d.first("content", "caption", "ocr_text", "transcript")}, source=modal)
scalar("TXT14_snippet", lambda d: {"snippet": "substr(text, 1, 500)"})
scalar("TXT15_caption_and_ocr", lambda d: {"combined": f"concat_ws(chr(10), case when {d.strip('caption')} <> '' then '[CAPTION] ' || {d.strip('caption')} end, case when {d.strip('ocr_text')} <> '' then '[OCR] ' || {d.strip('ocr_text')} end)"}, source=modal)
scalar("TXT16_citation_part", lambda d: {"part": "coalesce(nullif(" + d.sub(d.sub(d.strip(d.sub("url || ' [' || page_id || '] é'", r"[\[\]]", "''")), r"\s+", "'_'"), r"[^\p{L}\p{N}_\-.#]+", "'_'") + ", ''), 'unknown')"}, source="pages", key="page_id")
scalar("TXT18_chunk_id", lambda d: {"chunk_id": f"source || '_0_' || n_chars || '_' || substr({d.sha1("concat_ws('|', source, 0, n_chars)")}, 1, 16)"})
scalar("TXT20_claims", lambda d: {"claims": d.join(d.filter(d.sentences(d.strip(d.sub(d.sub(d.sub("answer", r"\[[^\]]*\]", "' '"), r"(?i)\*\*answer:\*\*|answer:", "' '"), r"\s+", "' '"))), "c", d.size(d.words("c")) + " >= 2"), "'|'")}, source=answers)
scalar("TXT21_response_cleanup", lambda d: {"cleaned": d.strip(d.sub(d.sub(d.sub("'**Answer:** Based on the context, ' || answer || chr(10) || chr(10) || chr(10) || '```'", r"```[a-z]*", "''"), r"^\s*(\*\*)?Answer:(\*\*)?\s*(Based on[^,:]*context[,:]\s*)?", "''"), r"\n\n+", "chr(10) || chr(10)"))}, source=answers)
scalar("TXT22_context_normalization", lambda d: {"context": "substr(" + d.strip(d.sub(d.sub("text || chr(10) || 'Question: why? ANSWER:'", r"(?is)question:.*$", "''"), r"(?i)answer:\s*$", "''")) + ", 1, 28000)"})
scalar("TXT23_json_extraction", lambda d: {"event": d.json(d.extract("'```json ' || props || ' ``` end'", r"(?s)\{.*\}"), "session"), "found": d.extract("'noise ' || props || ' tail'", r"(?s)\{.*\}")}, source="events", key="event_id")
scalar("TXT24_hms", lambda d: {"hms": d.hms("value")}, source="events", key="event_id", where=lambda d: "value >= 0")
scalar("TXT27_concise", lambda d: {"concise": "case when {0} like '%.' then {0} else {0} || '.' end".format(d.join(d.slice(d.split("text", r"\. "), "1", "2"), "'. '"))})
scalar("TXT28_frame_content", lambda d: {"content": f"concat_ws(chr(10), 'VIDEO FRAME [' || {d.hms('doc_id * 7')} || ']', case when length({d.strip('caption')}) > 5 then 'Caption: ' || {d.strip('caption')} end, case when length({d.strip('ocr_text')}) > 3 then 'Text: ' || {d.strip('ocr_text')} end, case when length({d.strip('transcript')}) > 5 then 'Audio: ' || {d.strip('transcript')} end)"}, source=modal)
scalar("TXT29_nested_path", lambda d: {"session": f"coalesce({d.json('props', 'session')}, 'none')", "missing": f"coalesce({d.json('props', 'no.such')}, 'default')"}, source="events", key="event_id")
scalar("TXT30_display_snippet", lambda d: {"shown": f"replace(substr({picked(d)}, 1, 300), chr(10), ' ') || case when length({picked(d)}) > 300 then ' ... (' || length({picked(d)}) || ' chars)' else '' end"}, source=modal)
scalar("TXT31_eval_ids", lambda d: {"id": "coalesce(nullif(case when conv_id % 2 = 0 then '' else 'c' || conv_id end, ''), role || '-' || turn)", "excerpt": d.first("case when turn = 1 then '' else substr(text, 1, 80) end", "text")}, source="conversations", key="conv_id, turn")
scalar(
    "TXT32_language_names",
    lambda d: {
        "name": "case lang " + " ".join(f"when '{a}' then '{b}'" for a, b in LANGUAGES) + " else lang end",
        "ocr_group": "case when lang = 'ta' then 'en,ta' when lang = 'ml' then 'en,ml' when lang in ('te', 'kn') then 'en,' || lang when lang in ('hi', 'mr', 'ne') then 'en,' || lang else 'en' end",
    },
)
scalar("FIL05_abstention", lambda d: {"verifier": d.any_of("lower(answer)", ABSTAIN), "generator": d.any_of("lower(answer)", ABSTAIN_GENERATOR)}, source=answers)


def hedging(d: Dialect, x: str) -> str:
    return f"least(0.3, {d.count_of(f'lower({x})', HEDGES)} * 0.1)"


scalar("FIL06_hedging_penalty", lambda d: {"penalty": f"round(cast({hedging(d, 'answer')} as double), 6)"}, source=answers)
# fixed values: the composed response's wording, in order
NOTHING = "I couldn't generate a response based on the available information."
NOT_ENOUGH = ("I don't have enough information in the provided documents to answer that confidently.", "I don’t have enough information in the provided documents to answer that confidently.")
SHARE = "If you can share more context—such as the specific section, page, or figure—you want explained, I can give you a much more precise answer."
DETAIL, EXTRACTED = "Here’s how to understand this in more detail:", "Based on the document, here’s what can be extracted:"
LIMITED = "⚠️ Note: The available information is limited, so this explanation may not capture all details."
FURTHER = "If you want to explore this further, you could:"


def chat_response(d: Dialect, concise: str, long: str, intent: str, level: str, actions: str) -> str:
    """The response for a short and a long answer, an intent, a confidence level and an array of next actions."""
    c, more, nl = d.strip(f"coalesce({concise}, '')"), d.strip(f"coalesce({long}, '')"), "chr(10)"
    t = lambda s: f"{d.text(s)}"
    lead = f"case when {intent} in ('analytical', 'comparison') then {t(DETAIL)} || {nl} || {nl} when {intent} = 'extraction' then {t(EXTRACTED)} || {nl} || {nl} else '' end"
    steps = f"{nl} || '- ' || {d.join(d.slice(actions, '1', '2'), nl + ' || ' + d.text('- '))}"
    body = f"concat_ws({nl}, case when {c} = '' then null when {c} like '%.' then {c} else {c} || '.' end, case when {more} <> '' then {nl} || {lead} || {more} end, case when {level} = 'LOW' then {nl} || {t(LIMITED)} end, case when {d.size(actions)} > 0 then {nl} || {t(FURTHER)} || {steps} end)"
    return f"case when {c} = 'Insufficient evidence' then {t(NOT_ENOUGH[0])} || {nl} || {nl} || {t(SHARE)} when contains(upper({c}), 'INSUFFICIENT CONTEXT') then {t(NOT_ENOUGH[1])} || {nl} || {nl} || {t(SHARE)} else {d.strip(body)} end"


@template("TXT26_chat_response")
def _chat(d: Dialect) -> str:
    """Answers with the intent, level and next actions that their ids stand for, as the tables hold none."""
    made = f"""(select doc_id, case when doc_id % 13 = 0 then 'Insufficient evidence' else answer end as concise, case when doc_id % 2 = 0 then text else '' end as long_answer, case doc_id % 4 when 0 then 'factual_qa' when 1 then 'analytical' when 2 then 'extraction' else 'comparison' end as intent,
        case when {hedging(d, 'answer')} >= 0.2 then 'LOW' else 'HIGH' end as level, {d.slice(d.array("'read ' || source", "'ask for ' || lang", "'stop'"), '1', 'cast(doc_id % 4 as int)')} as actions from {answers(d)} a)"""
    return f"select doc_id, {chat_response(d, 'concise', 'long_answer', 'intent', 'level', 'actions')} as response from {made} m"


# fixed values: the verdicts on averages, by band
BANDS = (
    ("confidence", ">=", ((0.90, "✅ Excellent confidence scores (≥0.90)"), (0.80, "✓ Good confidence scores (≥0.80)")), "⚠️  Confidence needs improvement (<0.80)"),
    ("citation_rate", ">=", ((0.80, "✅ Excellent grounding/citation rate (≥80%)"), (0.60, "✓ Good grounding/citation rate (≥60%)")), "⚠️  Citations need improvement (<60%)"),
    ("seconds", "<=", ((5.0, "✅ Excellent latency (≤5s)"), (10.0, "✓ Good latency (≤10s)")), "⚠️  Latency needs optimization (>10s)"),
    ("words", ">=", ((100, "✅ Comprehensive answers (≥100 words)"), (50, "✓ Adequate answer length (≥50 words)")), "⚠️  Answers too brief (<50 words)"),
)


@template("TXT33_banding")
def _banding(d: Dialect) -> str:
    """Verdicts on each language's average quality, toxicity, hundreds of characters (as seconds) and words."""
    columns = ", ".join("case " + " ".join(f"when {name} {sign} {limit} then {d.text(said)}" for limit, said in bands) + f" else {d.text(rest)} end as {name}" for name, sign, bands, rest in BANDS)
    return f"""select lang, {columns} from (select lang, avg(cast(quality as double)) as confidence, avg(cast(1 - toxic as double)) as citation_rate, avg(cast(n_chars as double)) / 100 as seconds, avg(cast({d.size(d.words('text'))} as double)) as words from documents x join labels l on l.doc_id = x.doc_id group by lang) v"""


@template("TXT17_citation_ids")
def _citation_ids(d: Dialect) -> str:
    base = f"{d.sub('source', '^.*/', chr(39) * 2)} || '#' || (doc_id % 50)"
    return f"select doc_id, base || case when n > 1 then '~' || n else '' end as cite_id from (select doc_id, base, row_number() over (partition by base order by doc_id) as n from (select doc_id, {base} as base from documents) b) t"


@template("TXT19_citation_extraction")
def _citations(d: Dialect) -> str:
    found = d.filter(d.map(d.all("answer", r"\[([^\[\]]+?)\]", 1), "c", "trim(c)"), "c", "c = cite or contains(c, '#')")
    return f"select doc_id, {d.join(d.unique(found), chr(39) + '|' + chr(39))} as cites from {answers(d)} a"


@template("TXT25_context_document")
def _context(d: Dialect) -> str:
    """A section for each modality of a query's ten best hits, best first."""
    body = f"'[' || source || '#' || m.doc_id || '] ' || case modality when 'video' then substr(content, 1, {VIDEO_CHARS}) when 'audio' then substr(content, 1, {AUDIO_CHARS}) else content end"
    parts = d.gather(body, "rk", "chr(10)")
    return f"with {bm25(d)}, {ranked('top', 'bm')} select query_id, modality, upper(modality) || ' EVIDENCE' || chr(10) || {parts} as section from top t join {modal(d)} m on m.doc_id = t.doc_id group by query_id, modality"


@template("FIL01_quality_filter")
def _quality(d: Dialect) -> str:
    solid = f"length({d.sub('text', r'[^\p{L}\p{N}]', chr(39) * 2)})"
    return f"select doc_id, length({d.strip('text')}) as stripped from documents where length({d.strip('text')}) >= 50 and {solid} * 1.0 / length(text) >= 0.3"


@template("FIL03_ocr_confidence")
def _ocr(d: Dialect) -> str:
    return "select event_id, value from events where value >= 0.3"


@template("FIL04_edge_density_gate")
def _edges(d: Dialect) -> str:
    """Frames whose edge density, here an event's value over 1000, is worth reading."""
    return "select event_id, round(value / 1000, 6) as density from events where value / 1000 >= 0.15"


@template("FIL07_malformed_chunks")
def _malformed(d: Dialect) -> str:
    return "select doc_id, chunk_id from (select doc_id, case when doc_id % 9 = 0 then '' when doc_id % 10 = 0 then null else source || doc_id end as chunk_id from documents) t where chunk_id is not null and chunk_id <> ''"


@template("FIL08_valid_pairs")
def _pairs(d: Dialect) -> str:
    return f"select q.conv_id from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where {d.strip('q.text')} <> '' and {d.strip('a.text')} <> ''"


@template("FIL09_sample")
def _sample(d: Dialect) -> str:
    return "select doc_id from documents order by md5(cast(doc_id as varchar(20)) || ':7'), doc_id limit 50"
