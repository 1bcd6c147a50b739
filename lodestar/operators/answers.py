"""Verification of answers and the heuristics of generation."""

from __future__ import annotations

from ..catalog import template
from ..plans.dialect import Dialect
from .text import ABSTAIN, ABSTAIN_GENERATOR, answers, hedging

# fixed values: weights of the final confidence
WEIGHTS = (0.35, 0.30, 0.20, 0.15)
GENERATOR_HEDGES = ("might", "could", "possibly", "perhaps", "may be", "seems")
SUPPORTED = 0.65
BRACKETS = r"\[[^\[\]]+\]"
PAIRS = 8


def level(x: str, high: float = 0.8, medium: float = 0.5) -> str:
    return f"case when {x} >= {high} then 'HIGH' when {x} >= {medium} then 'MEDIUM' else 'LOW' end"


def overlap(d: Dialect, hypothesis: str, evidence: str, factor: str) -> str:
    """Share of the hypothesis's terms (arrays) that the evidence has, times the factor, at most 1."""
    return f"least(1e0, cast({d.common(hypothesis, evidence)} as double) / greatest({d.size(hypothesis)}, 1) * {factor})"


def checked(d: Dialect) -> str:
    """ck: an answer with its terms, its context's terms, citations and cited share of sentences."""
    cites = d.unique(d.map(d.all("answer", r"\[([^\[\]]+?)\]", 1), "c", "trim(c)"))
    said = d.slice(d.filter(d.sentences("answer"), "s", "length(s) > 12"), "1", "8")
    return f"""ck as (select *, {d.size(d.filter('used', 'u', 'u = cite'))} as n_valid, {d.size('used')} as n_used, {d.size(d.filter('said', 's', d.matches('s', r'\[[^\[\]]+\]')))} as n_cited, {d.size('said')} as n_said
        from (select doc_id, answer, cite, text, {d.terms('answer')} as a_t, {d.terms('text')} as c_t, {cites} as used, {said} as said from {answers(d)} a) p)"""


COVERAGE = "cast(n_cited as double) / greatest(n_said, 1)"
CITATION = f"case when n_used = 0 then 0.2e0 else 0.3e0 + 0.4e0 * n_valid / n_used + 0.3e0 * least(1e0, {COVERAGE} / 0.3e0) end"


def support(d: Dialect) -> str:
    return f"case when {d.size('a_t')} = 0 then 0.5e0 else {overlap(d, 'a_t', 'c_t', '1.2e0')} end"


def claim_pairs(d: Dialect) -> str:
    """cl as (doc_id, place, claim, score): up to eight sentences and their overlap with the context."""
    pairs = d.unnest("ck", "doc_id, c_t", "said", "claim", "place")
    return f"cl as (select doc_id, place, claim, {overlap(d, d.terms('claim'), 'c_t', '1.3e0')} as score from {pairs} t)"


template("VER01_overlap_score")(lambda d: f"with {checked(d)} select doc_id, round({overlap(d, 'a_t', 'c_t', '1.3e0')}, 6) as score from ck")
template("VER02_mean_overlap")(lambda d: f"with {checked(d)}, {claim_pairs(d)} select doc_id, round(least(1e0, avg(score / 1.3e0) * 1.2e0), 6) as score from cl where {d.size(d.terms('claim'))} > 0 group by doc_id")
template("VER03_evidence_support")(lambda d: f"with {checked(d)} select doc_id, round({support(d)}, 6) as score from ck")
template("VER04_citation_score")(lambda d: f"with {checked(d)} select doc_id, n_used, n_valid, n_used - n_valid as n_invalid, round({COVERAGE}, 6) as coverage, round({CITATION}, 6) as score from ck")
def evidence_claims(d: Dialect) -> str:
    """ev as (doc_id, place, claim, cite_ids, cite, c_t): the structured evidence, sentences that cite something."""
    cited = d.filter(d.sentences("answer"), "s", f"length(s) > 10 and {d.matches('s', BRACKETS)}")
    return f"""ev as (select doc_id, place, {d.strip(d.sub('sentence', r'\[[^\[\]]*\]', "''"))} as claim, {d.map(d.all('sentence', r'\[([^\[\]]+?)\]', 1), 'c', 'trim(c)')} as cite_ids, cite, c_t from {d.unnest('ck', 'doc_id, cite, c_t', cited, 'sentence', 'place')} t)"""




@template("VER05_claim_pairs")
def _pairs(d: Dialect) -> str:
    """(claim, cited chunk) pairs: of the structured evidence, and where they are under two also of the answer's
    sentences; at most eight."""
    known = f"{d.size(d.filter('cite_ids', 'c', 'c = cite'))}"
    said = d.map(d.all("sentence", r"\[([^\[\]]+?)\]", 1), "c", "trim(c)")
    return f"""with {checked(d)}, {evidence_claims(d)}, first_ as (select doc_id, place, claim, {known} as n from ev where claim <> ''),
        many as (select doc_id, sum(n) as n from first_ group by doc_id),
        second_ as (select doc_id, place, {d.strip(d.sub('sentence', BRACKETS, "''"))} as claim, {d.size(d.filter(said, 'c', 'c = cite'))} as n from {d.unnest('ck', 'doc_id, cite', 'said', 'sentence', 'place')} t),
        both_ as (select doc_id, 0 as kind, place, claim, n from first_ where n > 0 union all select s.doc_id, 1, s.place, s.claim, s.n from second_ s left join many m on m.doc_id = s.doc_id where s.n > 0 and s.claim <> '' and coalesce(m.n, 0) < 2),
        each_ as (select doc_id, kind, place, claim from {d.unnest('both_', 'doc_id, kind, place, claim', d.count_up('1', 'n'), 'copy_')} u)
        select doc_id, cast(k as int) as pair, claim from (select *, row_number() over (partition by doc_id order by kind, place) as k from each_) r where k <= {PAIRS}"""


def claim_support(d: Dialect) -> str:
    """cl6 as (doc_id, place, claim, score): the largest overlap of a claim with a chunk that it cites, else 0."""
    return f"cl6 as (select doc_id, place, claim, case when claim <> '' and {d.size(d.filter('cite_ids', 'c', 'c = cite'))} > 0 then {overlap(d, d.terms('claim'), 'c_t', '1.3e0')} else 0e0 end as score from ev)"


template("VER06_claim_support")(lambda d: f"with {checked(d)}, {evidence_claims(d)}, {claim_support(d)} select doc_id, place, round(score, 6) as score, score >= {SUPPORTED} as supported from cl6")


def verdict(d: Dialect) -> str:
    w = WEIGHTS
    return f"""{checked(d)}, {evidence_claims(d)}, {claim_support(d)}, cs as (select doc_id, avg(case when score >= {SUPPORTED} then cast(1 as double) else 0 end) as claims from cl6 group by doc_id),
        vd as (select ck.doc_id, answer, cite, used, n_used, n_valid, n_said, n_cited, {support(d)} as evidence, greatest(0e0, least(1e0, {w[0]}e0 * {support(d)} + {w[1]}e0 * ({CITATION}) + {w[2]}e0 * coalesce(claims, 0.5e0) + {w[3]}e0 * 0.5e0 - cast({hedging(d, 'answer')} as double) - 0.1e0 * (n_used - n_valid))) as confidence, {d.any_of('lower(answer)', ABSTAIN)} as abstains from ck left join cs on cs.doc_id = ck.doc_id)"""


template("VER07_final_confidence")(lambda d: f"with {verdict(d)} select doc_id, round(confidence, 6) as confidence, {level('round(confidence, 6)')} as level, round(confidence, 6) >= 0.7 as accepted, round(confidence, 6) > 0.25 and round(confidence, 6) < 0.7 as retry from vd")
template("VER08_abstention")(lambda d: f"with {verdict(d)} select doc_id, case when abstains then 0.95e0 else round(confidence, 6) end as confidence, case when abstains then 'HIGH' else {level('round(confidence, 6)')} end as level, abstains or round(confidence, 6) >= 0.7 as verified from vd")
# fixed values: the reasons' wording, in order, and the least citation coverage
INVALID, LOW_COVERAGE, WEAK = "Invalid citations: ", "Low citation coverage (", "Weak evidence support from NLI"
STRONG, SUPPORT, MODERATE, LIMITED = "Strong grounding: ", " NLI support", "Moderate grounding with acceptable citations", "Limited grounding"
LEAST_COVERAGE = 0.3


@template("VER09_reason")
def _reason(d: Dialect) -> str:
    t, listed = d.text, d.map(d.filter("used", "u", "u <> cite"), "u", "chr(39) || u || chr(39)")
    return f"""with {verdict(d)}, r as (select doc_id, confidence, evidence, n_valid, concat_ws('; ', case when n_used > n_valid then {t(INVALID)} || '[' || {d.join(listed, "', '")} || ']' end, case when {COVERAGE} < {LEAST_COVERAGE} then {t(LOW_COVERAGE)} || {d.percent(COVERAGE)} || ')' end, case when evidence < 0.5 then {t(WEAK)} end) as why from vd)
    select doc_id, case when why <> '' then why when round(confidence, 6) >= 0.8 then {t(STRONG)} || n_valid || ' valid citations, ' || {d.percent('evidence')} || {t(SUPPORT)} when round(confidence, 6) >= 0.6 then {t(MODERATE)} else {t(LIMITED)} end as reason from r"""


@template("GEN01_generator_confidence")
def _generator(d: Dialect) -> str:
    long_terms = lambda x: d.distinct(d.filter(d.words(f"lower({x})"), "w", "length(w) > 4"))
    hedges = d.count_of("' ' || lower(answer) || ' '", tuple(f" {h} " for h in GENERATOR_HEDGES))
    return f"""with {checked(d)}, g as (select doc_id, answer, n_used, n_valid, {long_terms('answer')} as a, {long_terms('text')} as c from ck)
        select doc_id, case when {d.any_of('lower(answer)', ABSTAIN_GENERATOR)} then 0.92e0 else round(greatest(0e0, least(1e0, 0.55e0 + case when n_used > 0 then least(0.25e0, n_valid * 0.05e0) - (n_used - n_valid) * 0.08e0 else -0.15e0 end
            + case when length(answer) > 150 and length(answer) < 1200 then 0.12e0 when length(answer) > 80 and length(answer) <= 150 then 0.05e0 when length(answer) < 50 then -0.12e0 else 0e0 end
            + case when {d.size('a')} > 0 and {d.size('c')} > 0 then least(0.15e0, cast({d.common('a', 'c')} as double) / {d.size('a')} * 0.4e0) else 0e0 end - case when {hedges} > 3 then 0.08e0 else 0e0 end)), 6) end as confidence from g"""


template("GEN02_evidence_structure")(lambda d: f"select doc_id, place, {d.strip(d.sub('sentence', r'\[[^\[\]]*\]', chr(39) * 2))} as claim, {d.join(d.all('sentence', r'\[([^\[\]]+?)\]', 1), chr(39) + '|' + chr(39))} as cite_ids from {d.unnest(answers(d) + ' a', 'doc_id', d.filter(d.sentences('answer'), 's', 'length(s) > 10'), 'sentence', 'place')} t where {d.matches('sentence', r'\[[^\[\]]+\]')}")


# fixed values: for each asked quantity the words that ask for it, the patterns of its number, the value preferred, and the range
QUANTITIES = (
    ("d_model", ("d_model", "model dimension"), (r"\bd_model\b\D{0,40}?(\d{2,5})", r"\bdmodel\b\D{0,40}?(\d{2,5})"), 512, (128, 20_000)),
    ("d_k", ("d_k", "queries and keys"), (r"\bd_k\b\s*=\s*d_v\b\s*=\s*(\d{1,4})", r"\bd_k\b\D{0,40}?(\d{1,4})", r"\bdk\b\D{0,40}?(\d{1,4})"), 64, (8, 512)),
    ("d_ff", ("d_ff", "feed-forward"), (r"\bd_ff\b\D{0,40}?(\d{2,5})", r"\bdff\b\D{0,40}?(\d{2,5})", r"\bfeed[- ]forward\b\D{0,40}?(\d{2,5})"), 2048, (256, 20_000)),
    ("heads", ("head",), (r"\bheads?\b\D{0,20}?(\d{1,3})", r"\bmulti-head\b\D{0,20}?(\d{1,3})", r"h\s*=\s*(\d{1,3})", r"(eight|eight\s+heads)"), 8, (1, 32)),
)
OPTIMIZER = r"\bAdam\b"
CHUNK, NO_CONTENT = "[CHUNK", ("[CHUNK", "=====", "INSTRUCTIONS")


def extracted(d: Dialect, source: str) -> str:
    """(key, intent, answer) of source (key, query, context): the number beside the quantity that the query asks for,
    in its range, the preferred one if it is there, else the most frequent, ties to the smallest; the optimizer by its
    name; else the first content after a chunk's header; else an abstention. The whole context is read."""
    asked = "case " + " ".join(f"when {d.any_of('lower(query)', words)} then {d.text(name)}" for name, words, *_ in QUANTITIES) + " when contains(lower(query), 'optimizer') then 'optimizer' else 'general' end"
    base = f"(select key, context, {asked} as intent from {source} x)"
    number = lambda item: f"case when lower({item}) like 'eight%' then 8 else cast({item} as int) end"
    numbers = " union all ".join(
        f"select key, v, {best} as best from (select key, {number('item')} as v from {d.unnest(f'(select * from {base} b{i}_{k} where intent = {d.text(name)}) c{i}_{k}', 'key', d.all('context', '(?i)' + pattern, 1), 'item')} t{i}_{k}) u{i}_{k} where v between {low} and {high}"
        for i, (name, _, patterns, best, (low, high)) in enumerate(QUANTITIES)
        for k, pattern in enumerate(patterns)
    )
    lines = d.filter(d.map(d.split("context", r"\r?\n"), "l", d.strip("l")), "l", "l <> ''")
    header = lambda j: f"substr({d.at('lines', f'greatest({j}, 1)')}, 1, {len(CHUNK)}) = {d.text(CHUNK)}"
    content = " and ".join(f"substr({d.at('lines', 'j')}, 1, {len(p)}) <> {d.text(p)}" for p in NO_CONTENT)
    places = d.filter(d.count_up("2", f"greatest({d.size('lines')}, 2)"), "j", f"j <= {d.size('lines')} and {content} and ({' or '.join(header(f'j - {k}') for k in (1, 2, 3, 4))})")
    fallback = f"coalesce({d.at('lines', d.at(places, '1'))}, 'Insufficient evidence')"
    return f"""with n as ({numbers}), r as (select key, v, row_number() over (partition by key order by case when v = max(best) then 0 else 1 end, count(*) desc, v) as k from n group by key, v)
        select s.key, s.intent, coalesce(case when s.intent = 'optimizer' and {d.matches('s.context', '(?i)' + OPTIMIZER)} then 'Adam' else cast(r.v as varchar(10)) end, fallback) as answer
        from (select key, intent, context, {fallback} as fallback from (select key, intent, context, {lines} as lines from {base} l) m) s left join r on r.key = s.key and k = 1"""


@template("GEN03_extractive_answer")
def _extractive(d: Dialect) -> str:
    """Contexts are documents after a line that states some quantities, as the tables hold none."""
    stated = "case doc_id % 7 when 0 then 'With d_model = ' || (doc_id % 700) || '; dmodel ' || (n_chars % 700) when 1 then 'd_k = d_v = ' || (doc_id % 90) || ', dk: ' || (n_chars % 80) when 2 then 'the feed-forward layer has ' || (doc_id * 7 % 3000) || ', dff ' || (n_chars % 3000) when 3 then 'eight heads, multi-head ' || (doc_id % 40) || ', h = ' || (n_chars % 9) when 4 then 'The Adam optimizer' else '[CHUNK ' || doc_id || ']' end"
    asked = "case doc_id % 7 when 0 then 'What is the model dimension?' when 1 then 'How large are queries and keys?' when 2 then 'What is d_ff?' when 3 then 'How many heads?' when 4 then 'Which optimizer?' else 'What is it about?' end"
    return extracted(d, f"(select doc_id as key, {asked} as query, {stated} || chr(10) || text as context from documents)").replace("select s.key, s.intent", "select s.key as doc_id, s.intent", 1)


@template("GEN04_small_model_confidence")
def _small(d: Dialect) -> str:
    a, c = d.distinct(d.words("lower(answer)")), d.distinct(d.words("lower(text)"))
    return f"select doc_id, confidence, {level('confidence', 0.7, 0.4)} as level from (select doc_id, case when {d.any_of('lower(answer)', ('don' + chr(39) + 't have', 'insufficient'))} then 0.2e0 when {d.any_of('lower(answer)', ('unsure', 'not clear'))} then 0.4e0 else round(least(0.7e0 + cast({d.common('a', 'c')} as double) / greatest({d.size('a')}, 1) * 0.2e0, 0.95e0), 6) end as confidence from (select doc_id, answer, {a} as a, {c} as c from {answers(d)} x) y) z"


template("GEN06_source_list")(lambda d: f"select conv_id, {d.gather('source', 'first_turn', chr(39) + ',' + chr(39))} as sources from (select conv_id, 'src' || (turn % 3) as source, min(turn) as first_turn from conversations where turn <= 5 group by conv_id, 'src' || (turn % 3)) s group by conv_id")
template("GEN07_prompt_choice")(lambda d: f"select doc_id, case when contains(answer, '[C') then case when length(answer) > 500 then 'few_shot' else 'structured' end else 'simple' end as prompt from (select doc_id, case when doc_id % 2 = 0 then replace(answer, '[src', '[Csrc') else answer end as answer from {answers(d)} a) b")
