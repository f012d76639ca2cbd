"""Which kind of question it is, and the term it asks about (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docevidence.functions.text import WS, term_key, trim

# The phrases around a term in a definition question, what is no term, and words that tie a question to a patient or to care.
LEADING = [
    r"^(?:please\s+)?(?:can|could|would|will)\s+you\s+(?:please\s+)?",
    r"^(?:please\s+)?(?:tell\s+me|explain|describe|define|clarify)\s+(?:to\s+me\s+)?(?:what\s+|about\s+)?",
    r"^what(?:'s|s)?\s+(?:is|are|was|were)\s+(?:the\s+)?(?:meaning|definition)\s+of\s+",
    r"^what(?:'s|s)?\s+(?:is|are|was|were)\s+",
    r"^what\s+(?:does|do)\s+",
    r"^(?:the\s+)?(?:meaning|definition)\s+of\s+",
    r"^(?:an?|the)\s+",
]
TRAILING = [
    r"\s+(?:mean|means|meaning)\z",
    r"\s+(?:stand|stands)\s+for\z",
    r"\s+in\s+(?:simple|plain)\s+(?:terms|words|english)\z",
    r"\s+in\s+medical\s+terms\z",
    r"\s+medically\z",
    r"\s+(?:is|are)\z",
    r"\s+(?:medical\s+)?(?:term|definition)\z",
]
DEFINITIONAL = r"^(?:please\s+)?(?:can|could|would|will|tell|explain|describe|define|clarify|what|the\s+(?:meaning|definition)|meaning|definition)\b|\s(?:mean|means|meaning)\z|\s+stands?\s+for\z"
PATIENT = r"\b(my|mine|his|her|their|patient|patients|patient's|report|reports|document|documents|uploaded|result|results|value|values|reading|readings|this|these|those|last|latest|current)\b"
CLINICAL = r"\b(risk|risks|risky|danger|dangerous|serious|severe|severity|urgent|urgency|emergency|life[- ]threatening|treat|treated|treatment|treatments|therapy|cure|prognosis|complication|complications|should i|do i need|is it safe|what causes|cause of|causes of|guideline|guidelines|recommend|recommended|dose|dosage|prescribe|worried|worry|prevent|prevention|manage|management|side effects?)\b"
ASKS_DOES, ENDS_IN_VERB = r"^what\s+(?:does|do)\b", r"\s(?:mean|means|stand|stands)(?:\s+for)?\z"
BARE_PRONOUN, ARTICLE, CLOSING_TEST = r"^(?:it|that|this|these|those|there|here|more)\z", r"^(?:an?|the|my)\s+", r"\s+(?:test|tests|level|levels)\z"
REPORT_LOOKUP = r"^\s*(?:what|whats|what's)\s+(?:(?:was|were)\b|(?:is|are)\s+the\s+(?!(?:meaning|definition)\b))"


def definition_term(question: Column) -> Column:
    """Q1: the term of a definition question, null for any other question."""
    t = F.regexp_replace(F.lower(trim(question)), "[\"“”‘’]", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?:[?!.]|{WS})+\z", ""), rf"{WS}+", " ")
    asks = t.rlike(DEFINITIONAL) & ~(t.rlike(ASKS_DOES) & ~t.rlike(ENDS_IN_VERB))
    out = t
    for pattern in (LEADING + TRAILING) * 3:  # a pass that changes nothing changes nothing later
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(out)
    words = F.size(F.filter(F.split(out, " "), lambda w: w != ""))
    return F.when(asks & words.between(1, 8) & (F.length(out) <= 100) & ~out.rlike(BARE_PRONOUN), out)


def lookup_keys(question: Column, most: int = 4) -> Column:
    """Q2: keys to look a term up by: as asked, without article, without a closing "test" or "level"."""
    term = F.coalesce(definition_term(question), F.regexp_replace(F.lower(trim(question)), rf"(?:[?!.]|{WS})+\z", ""))
    bare = F.regexp_replace(term, ARTICLE, "")
    keys = F.array(term_key(term), term_key(bare), term_key(F.regexp_replace(bare, CLOSING_TEST, "")))
    words = F.size(F.filter(F.split(term, rf"{WS}+"), lambda w: w != ""))
    return F.when(words.between(1, 8), F.slice(F.array_distinct(F.filter(keys, lambda k: k != "")), 1, most)).otherwise(F.array().cast("array<string>"))


def classify_question(question: Column) -> Column:
    """Q3: (kind, term): terminology, clinical or report."""
    t = F.lower(trim(question))
    term = F.when(~t.rlike(REPORT_LOOKUP), definition_term(t))
    defines = term.isNotNull() & ~term.rlike(PATIENT) & ~term.rlike(CLINICAL)
    return F.struct(F.when(defines, "terminology").when(t.rlike(CLINICAL), "clinical").otherwise("report").alias("kind"), F.when(defines, term).alias("term"))
