"""Rules that classify a question without a model. Keyword lists are fixed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A keyword counts wherever it stands in the question, even inside another word; the first rule that has one wins.
SCOPES = {
    "company": ["our company", "our policy", "our procedure", "company policy"],
    "regulatory": ["marpol", "solas", "imo", "mlc", "stcw", "regulation", "annex", "chapter"],
    "safety": ["emergency", "drill", "fire", "abandon", "lifeboat", "evacuation", "alarm"],
    "operational": ["operation", "procedure", "checklist", "maintenance", "inspection"],
}
PREFERENCES = {
    "Form": ["form", "forms"],
    "Checklist": ["checklist", "checklists", "check list"],
    "Procedure": ["procedure", "procedures", "how to", "steps"],
    "Policy": ["policy", "policies"],
    "Manual": ["manual", "manuals", "guide"],
    "Regulation": ["regulation", "regulations", "requirement"],
}
GREETINGS = ["hi", "hello", "hey", "good morning", "good afternoon", "good evening", "howdy", "hey there"]
GOODBYES = ["bye", "goodbye", "see you", "take care"]


def first_match(text, rules: dict, default) -> Column:
    """The first rule that has one of its keywords anywhere in the text."""
    x, out = F.lower(text), None
    for name, keys in rules.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(x, F.lit(k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def scope(text) -> Column:
    return first_match(text, SCOPES, "general")


def type_preference(text) -> Column:
    return first_match(text, PREFERENCES, F.lit(None).cast("string"))


def intent(text) -> Column:
    """greeting for a greeting or two words without a question mark, goodbye, else new_query."""
    x = F.lower(F.trim(text))
    words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return F.when(x.isin(*GREETINGS) | ((words <= 2) & ~F.contains(x, F.lit("?"))), "greeting").when(x.isin(*GOODBYES), "goodbye").otherwise("new_query")


def answer_tone(pct) -> Column:
    return F.when(pct >= 80, "direct").when(pct >= 60, "hedged").otherwise("cautious")


#: Values that a model's plan may have, the default first, and other names for them (fixed values).
INTENTS = ["new_query", "greeting", "goodbye", "thank_you", "off_topic", "incomplete", "follow_up_same", "follow_up_new", "action_on_previous"]
INTENT_ALIASES = {"chitchat": "off_topic", "follow_up": "follow_up_same", "clarification": "follow_up_same"}
NEED_CONTEXT = ["follow_up_same", "follow_up_new", "action_on_previous"]
QUERY_TYPES = ["simple_factual", "procedural", "multi_part", "compliance", "content_generation"]
PLAN_SCOPES = ["focused", "broad", "too_broad"]
STRATEGIES = ["chunk", "section", "filtered_parallel"]
STRATEGY_ALIASES = {"chunk_level": "chunk", "section_level": "section"}
DECOMPOSED = ["multi_part", "compliance", "content_generation"]
MERGES = {"compliance": "compliance", "multi_part": "synthesize", "content_generation": "generative"}
REGULATORY = ["REGULATION", "VETTING"]
#: What the first rules look at (fixed values).
SMALL_TALK = [
    "hi", "hello", "hey", "good morning", "good afternoon", "good evening", "howdy", "yo", "hey there", "what's going on", "good day", "gday",
    "hi there", "what's up?", "what's up", "how are you", "whats up", "how's it going", "what's new",
]
UNCLEAR = ["what do you mean", "can you explain", "i don't understand", "unclear", "elaborate", "more details"]
MARITIME = [
    "ship", "vessel", "cargo", "ballast", "marpol", "solas", "imo", "procedure", "form", "checklist", "regulation", "policy", "drill", "manual", "chief engineer",
    "safety", "navigation", "engine", "crew", "master", "officer", "ppe", "supply", "logbook", "maintenance", "inspection", "emergency", "lifeboat", "fire",
    "pollution", "incident", "reporting", "deck", "engineer", "pilot", "mooring", "anchoring", "cargo handling", "stcw", "mlc", "ism code", "psc", "flag",
    "port state", "ship management", "seafarer", "nautical", "chart", "ice navigation", "hull", "machinery", "equipment",
]


def has_any(text, keys: list[str]) -> Column:
    """Whether one of the keys stands anywhere in the text."""
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.contains(text, F.lit(k))
    return hit


def heuristic_intent(text) -> Column:
    """greeting for small talk or up to three words, clarification for words that ask back, new_query for terms of the trade, a
    question mark or more than five words, else chitchat."""
    x = F.lower(F.trim(text))
    n = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return F.when(x.isin(*SMALL_TALK) | (n <= 3), "greeting").when(has_any(x, UNCLEAR), "clarification").when(has_any(x, MARITIME) | F.contains(x, F.lit("?")) | (n > 5), "new_query").otherwise("chitchat")


def one_of(value, allowed: list[str], aliases: dict | None = None) -> Column:
    """A model's value in lower case, by its alias; the default (the first) if it is none of those allowed."""
    x = F.lower(F.trim(value))
    for k, v in (aliases or {}).items():
        x = F.when(x == k, v).otherwise(x)
    return F.when(x.isin(*allowed), x).otherwise(allowed[0])


def plan_intent(value, has_context) -> Column:
    """A plan's intent; those that go on with a conversation are new queries without one."""
    x = one_of(value, INTENTS, INTENT_ALIASES)
    return F.when(x.isin(*NEED_CONTEXT) & ~has_context, "new_query").otherwise(x)


def needs_parts(query_type, plan_scope) -> Column:
    """Whether a question is taken apart: some types are, unless the scope is too broad."""
    return F.coalesce(query_type.isin(*DECOMPOSED) & (plan_scope != "too_broad"), F.lit(False))


def merge_strategy(query_type) -> Column:
    out = F.lit("direct")
    for k, v in MERGES.items():
        out = F.when(query_type == k, v).otherwise(out)
    return out


def is_regulatory(types) -> Column:
    """Whether one of an array of document types is a standard's."""
    return F.exists(types, lambda t: F.upper(t).isin(*REGULATORY))


def valid_parts(raw, types: list[str]) -> Column:
    """The sub-queries in a model's JSON list: those with text, a label for each, their types in capitals and cut to known ones (null
    if none is), whether they ask for a standard."""
    kind = "array<struct<text:string,source_label:string,doc_type_filter:array<string>,is_standard:boolean>>"
    got = F.coalesce(F.from_json(raw, kind), F.array().cast(kind))
    kept = F.filter(got, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    known = lambda s: F.filter(F.transform(F.coalesce(s["doc_type_filter"], F.array().cast("array<string>")), F.upper), lambda t: t.isin(*types))
    return F.transform(
        kept,
        lambda s: F.struct(
            F.trim(s["text"]).alias("text"),
            F.trim(F.coalesce(F.nullif(s["source_label"], F.lit("")), F.lit("sub-query"))).alias("label"),
            F.when(F.size(known(s)) > 0, known(s)).alias("types"),
            F.coalesce(s["is_standard"], F.lit(False)).alias("is_standard"),
        ),
    )


def strategy_of(strategy, query_type, parts) -> Column:
    """A plan's strategy: questions of compliance or generation that are taken apart go by filtered searches in parallel."""
    return F.when(query_type.isin("compliance", "content_generation") & parts, "filtered_parallel").otherwise(strategy)


def topic_of(topic, intent, has_context, last_topic) -> Column:
    """A plan's topic; a question that goes on with a conversation and names none inherits the last one."""
    own = F.nullif(topic, F.lit(""))
    return F.when(own.isNull() & has_context & intent.isin(*NEED_CONTEXT), last_topic).otherwise(own)


#: Prompts by merge strategy (fixed values).
PROMPTS = {"generative": "generative", "synthesize": "multi_part", "compliance": "comparison"}


def prompt_kind(merge, has_standard) -> Column:
    """Which prompt joins the parts of an answer: a comparison with a standard is a gap analysis."""
    out = F.lit("multi_part")
    for k, v in PROMPTS.items():
        out = F.when(merge == k, v).otherwise(out)
    return F.when((merge == "compliance") & has_standard, "gap_analysis").otherwise(out)
