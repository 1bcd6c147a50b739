"""Query planning rules and query expansion."""

from __future__ import annotations

from ..catalog import template
from ..plans.dialect import Dialect

# fixed values: keywords in the order in which the first hit decides, word pairs, and the k of each strategy
INTENTS = (
    ("comparative", ("compare", "difference", "vs", "versus", "contrast", "better")),
    ("explanatory", ("explain", "why", "how does", "describe", "what is")),
    ("visual_reasoning", ("diagram", "image", "figure", "chart", "visual", "picture", "photo")),
    ("temporal", ("when", "timeline", "history", "date", "year")),
    ("procedural", ("step", "process", "procedure", "how to", "guide", "tutorial")),
    ("aggregation", ("list", "all", "every", "summarize", "aggregate")),
)
CONJUNCTIONS = (" and ", " or ", " but ", " also ")
IMAGE = ("image", "diagram", "chart", "figure", "picture", "photo", "screenshot")
AUDIO = ("audio", "sound", "voice", "speech", "podcast", "lecture")
VIDEO = ("video", "movie", "clip", "recording", "watch")
OCR = ("text", "ocr", "read")
TABLE = ("table", "row", "column", "cell")
COMPUTE = ("calculate", "compute", "sum", "average", "count", "total")
CONTRACTIONS = (("don't", "do not"), ("doesn't", "does not"), ("didn't", "did not"), ("won't", "will not"), ("can't", "cannot"), ("couldn't", "could not"), ("shouldn't", "should not"), ("isn't", "is not"), ("aren't", "are not"), ("wasn't", "was not"), ("weren't", "were not"), ("haven't", "have not"), ("hasn't", "has not"), ("hadn't", "had not"), ("what's", "what is"), ("it's", "it is"), ("that's", "that is"))
TECHNICAL = (("ai", "artificial intelligence"), ("ml", "machine learning"), ("nlp", "natural language processing"), ("llm", "large language model"), ("rag", "retrieval-augmented generation"), ("embedding", "vector embedding"), ("model", "machine learning model"), ("training", "model training"), ("inference", "model inference"), ("optimization", "hyperparameter optimization"))
SIMPLE = (("embedding", "vector representation"), ("model", "system"), ("inference", "prediction"), ("optimization", "improvement"), ("hyperparameter", "setting"), ("architecture", "structure"), ("transformer", "attention-based network"), ("encoder", "processor"), ("decoder", "generator"))
DENSE_K, SPARSE_K, RERANK_K = 100, 100, 50
#: Questions that stand before the passages, so that every rule meets some query.
OPENINGS = ("What is", "Compare", "How to", "When was", "List all", "Show the image and the video of", "Why don't we calculate", "Is the AI model training", "It's audio:", "Read the text in the picture, table row")


def asked(d: Dialect) -> str:
    """Openings before whole passages, and before the last sentence of every other passage: long questions and short ones."""
    opening = "case item_id % 10 " + " ".join(f"when {i} then {d.text(o)}" for i, o in enumerate(OPENINGS)) + " end"
    last = d.at(d.sentences("text"), d.size(d.sentences("text")))
    return f"(select item_id, {opening} || ' ' || case when item_id % 2 = 0 then text else coalesce({last}, text) end || '?' as q from benchmark)"


def intent(d: Dialect, q: str = "lower(q)") -> str:
    """By the first rule that fits; a question without a word is unknown."""
    return "case " + " ".join(f"when {d.any_of(q, words)} then '{name}'" for name, words in INTENTS) + f" when not {d.matches(q, '[a-z0-9]')} then 'unknown' else 'factual' end"


def complexity(d: Dialect) -> str:
    marks = "length(q) - length(replace(q, '?', ''))"
    return f"case when {d.size(d.words('q'))} > 25 or {marks} > 1 then 'complex' when {d.size(d.words('q'))} > 12 or {d.any_of('lower(q)', CONJUNCTIONS)} then 'medium' else 'simple' end"


def planned(d: Dialect, source: str | None = None) -> str:
    """source (item_id, q), by default the made questions, with intent, complexity and modalities."""
    image = f"({intent(d)} = 'visual_reasoning' or {d.any_of('lower(q)', IMAGE)})"
    return f"(select item_id, q, {intent(d)} as intent, {complexity(d)} as complexity, {image} as image, {d.any_of('lower(q)', AUDIO)} as audio, {d.any_of('lower(q)', VIDEO)} as video, 1 + cast({image} as int) + cast({d.any_of('lower(q)', AUDIO)} as int) + cast({d.any_of('lower(q)', VIDEO)} as int) as n from {source or asked(d)} a)"


def _plan(name: str, columns) -> None:
    template(name)(lambda d: f"select item_id, {columns(d)} from {planned(d)} p")


_plan("PLN01_intent", lambda d: "intent")
_plan("PLN02_complexity", lambda d: f"complexity, case when {d.size(d.words('q'))} > 20 then 'complex' when {d.size(d.words('q'))} > 10 then 'medium' else 'simple' end as local_complexity")
_plan("PLN03_modalities", lambda d: "concat_ws(',', 'text', case when image then 'image' end, case when audio then 'audio' end, case when video then 'video' end) as modalities, round(cast(1 as double) / n, 6) as weight")
def strategy() -> str:
    """strategy and the k of each step, over planned()."""
    return f"case when complexity = 'simple' then 'dense_only' when intent in ('explanatory', 'comparative') then 'hybrid' when intent = 'visual_reasoning' then 'multimodal_fusion' else 'hybrid' end as strategy, case when complexity = 'simple' then 20 else {DENSE_K} end as dense_k, case when complexity = 'simple' then 0 when intent = 'visual_reasoning' then {SPARSE_K // 2} else {SPARSE_K} end as sparse_k, case when complexity = 'simple' then 10 else {RERANK_K} end as rerank_k"


_plan("PLN04_strategy", lambda d: strategy())
_plan("PLN05_tools", lambda d: f"concat_ws(',', case when image and {d.any_of('lower(q)', OCR)} then 'ocr_extractor' end, case when {d.any_of('lower(q)', TABLE)} then 'table_parser' end, case when {d.any_of('lower(q)', COMPUTE)} then 'code_interpreter' end) as tools")
#: An intent that no rule knows, a simple question, a plan by rules, more than two modalities.
_CONFIDENCE = "least(1e0, greatest(0e0, case when intent = 'unknown' then 0.6e0 else 1e0 end * case when complexity = 'simple' then 1.1e0 else 1e0 end * 0.95e0 * case when n > 2 then 0.9e0 else 1e0 end))"
_plan("PLN06_confidence", lambda d: f"round({_CONFIDENCE}, 6) as confidence, case when {_CONFIDENCE} >= 0.8 then 'HIGH' when {_CONFIDENCE} >= 0.5 then 'MEDIUM' else 'LOW' end as level")


def replaced(d: Dialect, x: str, pairs, guard: str | None = None) -> str:
    for a, b in pairs:
        new = f"replace(replace({x}, {d.text(a)}, {d.text(b)}), {d.text(a.upper())}, {d.text(b.upper())})"
        x = f"case when contains({guard}, {d.text(a)}) then {new} else {x} end" if guard else new
    return f"trim({x})"


def _stepwise(d: Dialect, pairs, asked_: str | None = None) -> str:
    """As replaced() with a guard on the original, one select for each rule: nested cases would double each time."""
    source = f"(select item_id, q, q as t from {asked_ or asked(d)} a)"
    for i, (a, b) in enumerate(pairs):
        source = f"(select item_id, q, case when contains(lower(q), {d.text(a)}) then replace(replace(t, {d.text(a)}, {d.text(b)}), {d.text(a.upper())}, {d.text(b.upper())}) else t end as t from {source} s{i})"
    return source


template("QEX01_contractions")(lambda d: f"select item_id, {replaced(d, 'q', CONTRACTIONS)} as formal from {asked(d)} a")
template("QEX02_technical")(lambda d: f"select item_id, trim(t) as technical from {_stepwise(d, TECHNICAL)} t")
template("QEX03_simplified")(lambda d: f"select item_id, {replaced(d, 'q', SIMPLE)} as simplified from {asked(d)} a")


def variants(d: Dialect, source: str) -> str:
    """(item_id, place, variant) of source (item_id, q): the question and its rewritings, each once, five at most."""
    return f"""(with v as (select item_id, 0 as place, q as variant from {source} a union all select item_id, 1, {replaced(d, 'q', CONTRACTIONS)} from {source} b union all select item_id, 2, trim(t) from {_stepwise(d, TECHNICAL, source)} c union all select item_id, 3, {replaced(d, 'q', SIMPLE)} from {source} e)
        select item_id, place, variant from (select item_id, place, variant, n, row_number() over (partition by item_id order by place) as k from (select *, row_number() over (partition by item_id, lower(trim(variant)) order by place) as n from v) r where n = 1) s where k <= 5)"""


template("QEX05_variants")(lambda d: f"select item_id, place, variant from {variants(d, asked(d))} w")


@template("QEX06_decomposition")
def _decomposition(d: Dialect) -> str:
    parts = d.filter(d.map(d.split("q", ", and | and | or |, "), "p", "trim(p)"), "p", "length(p) > 10")
    return f"select item_id, pos as place, part from {d.unnest(asked(d) + ' a', 'item_id', d.slice(d.unique(parts), '1', '5'), 'part')} t"
