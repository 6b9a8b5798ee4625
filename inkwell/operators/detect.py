"""Rule-based identifier detection over text columns.

Every rule is one pattern; checks (checksum, deny-list, trimming) follow on the
matches. All rules of a text are evaluated in its row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.spans import find_each, find_spans, let


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    #: The identifier is the pattern's first group (always its tail), not the match.
    tail: bool = False
    confidence: float = 1.0
    #: A pattern that every text with a match has and that fails at one
    #: character almost everywhere: texts without it aren't searched.
    cue: str = ""
    #: A condition without width that holds wherever a match begins, for
    #: patterns that most places then fail at once.
    lead: str = ""
    #: Classes of the first signs of every match in an ASCII text, by alternative
    #: (letters in either case); none for those that begin before an @.
    begins: tuple[str, ...] = ()

    @property
    def search(self) -> str:
        return self.lead + self.pattern


# The identifier patterns, in their order.
RULES = (
    Rule("EMAIL", r"(?iu)\b[A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,24}\b", cue="@"),
    Rule("PHONE", r"(?:\+44[ \t.-]?(?:\(0\)[ \t.-]?)?|\b0)[1-9](?:[ \t().-]?[0-9]){8,9}\b", lead=r"(?=[+0])", cue=r"(?:[0-9][ \t().-]?){9}", begins=("[+]44", "0[1-9][0-9 \t().-][0-9 \t().-]")),
    Rule("POSTCODE", r"(?iu)\b(?:GIR[ ]?0AA|[A-Z]{1,2}[0-9][0-9A-Z]?[ ]?[0-9][A-Z]{2})\b", cue=r"[0-9][A-Za-z\x{17f}\x{212a}]{2}", begins=("[a-z][0-9][a-z0-9 ]", "[a-z][a-z][0-9][a-z0-9 ]", "gir")),
    Rule("NHS_NUMBER", r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", cue=r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}", begins=("[0-9][0-9][0-9][ -][0-9][0-9][0-9][0-9 -]", "[0-9][0-9][0-9][0-9][0-9][0-9][0-9 -][0-9]")),
    Rule("NI_NUMBER", r"(?iu)\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[A-D]\b", cue=r"[0-9]{2} ?[0-9]{2} ?[0-9]{2}", begins=("[a-z][a-z][0-9][0-9]", "[a-z][a-z] [0-9][0-9]")),
    Rule("URL", r"(?iu)\b(?:https?://|www\.)[^\s\x{85}\p{Z}<>\x22]{1,2048}", cue=r"://|[wW]{3}[.]", begins=("http", "www")),
    Rule("DATE", r"\b(?:[0-3]?[0-9][/.-][01]?[0-9][/.-](?:[0-9]{4}|[0-9]{2})|[0-9]{4}-[01][0-9]-[0-3][0-9])\b", cue=r"[0-9][/.-][0-9]", begins=("[0-9][/.-][0-9]", "[0-9][0-9][/.-][0-9]", "[0-9][0-9][0-9][0-9]-")),
    Rule("DATE", r"(?iu)\b[0-3]?[0-9](?:st|nd|rd|th)?[ ]{1,3}(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(?:[ ,]{1,3}[0-9]{4})?\b", cue=r"[0-9](?:[sStTnNrR\x{17f}][tTdDhH])? ", begins=("[0-9][ snrt][ a-z]", "[0-9][0-9][ snrt][ a-z]")),
    Rule("CASE_REFERENCE", r"(?iu)\b(?:case|patient|hospital|record)[ ]{1,3}(?:ref(?:erence)?|id|number|no\.?)[ \t:#-]{0,5}([A-Z0-9][A-Z0-9/-]{2,39})\b", tail=True, lead=r"(?=[cCpPhHrR])", cue=r"[cCpPhHrR][aAoOeE][sStTcC\x{17f}](?iu:e|ient|pital|ord) {1,3}(?iu:ref|id|n)", begins=("cas", "pat", "hos", "rec")),
)
NHS_CONTEXT = Rule("NHS_NUMBER", r"(?iu)\bNHS[ \t]{1,3}(?:number|no\.?)[ \t:#-]{0,5}([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4})\b", tail=True, confidence=0.9, cue=r"[nN][hH][sS\x{17f}][ \t]", begins=("nhs",))
ADDRESS_LEAD = Rule("LOCATION", r"(?iu)\b(?:flat|apartment|unit|house)[ \t]{0,3}[A-Z0-9]{1,8},[ \t]{1,3}[0-9]{1,4}[ \t]{1,3}[A-Z][A-Z'’-]{1,39}[ \t]{1,3}(?:road|street|lane|avenue|close|drive|way|court|crescent|place|row)\b", confidence=0.9, lead=r"(?=[fFaAuUhH])", cue=r",[ \t]{1,3}[0-9]{1,4}[ \t]", begins=("fla", "apa", "uni", "hou"))
NI_DENIED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
URL_TAIL = ".,;)!?"
EVIDENCE = "array<struct<category:string,start:int,end:int,phrase:string,confidence:double>>"


def valid_nhs(value: Column) -> Column:
    """Ten digits, not all alike, whose weighted sum modulo 11 fits the last."""

    def check(digits: Column) -> Column:
        at = lambda i: F.substring(digits, i + 1, 1).cast("int")
        due = (11 - sum((at(i) * (10 - i) for i in range(9)), F.lit(0)) % 11) % 11
        return (F.length(digits) == 10) & ~digits.rlike(r"^(.)\1{9}$") & (due < 10) & (due == at(9))

    return let(F.regexp_replace(value, "[^0-9]", ""), check)


def ni_allowed(value: Column) -> Column:
    return ~F.upper(F.substring(value, 1, 2)).isin(*NI_DENIED)


def _cue(text: Column, rule: Rule) -> Column:
    return text.contains(rule.cue) if rule.cue.isalnum() or rule.cue == "@" else text.rlike(rule.cue)


def _kept(found: Column, rule: Rule) -> Column:
    """Evidence from a rule's matches: those that pass its check."""

    def evidence(x: Column) -> Column:
        value = F.regexp_extract(x["value"], rule.pattern, 1) if rule.tail else x["value"]
        if rule.category == "URL":
            value = F.rtrim(value, F.lit(URL_TAIL))
        start = x["end"] - F.length(value) if rule.tail else x["start"]
        return F.struct(F.lit(rule.category).alias("category"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("phrase"), F.lit(rule.confidence).alias("confidence"))

    out = F.transform(found, evidence)
    if rule.category == "NHS_NUMBER" and not rule.tail:
        out = F.filter(out, lambda x: valid_nhs(x["phrase"]))
    if rule.category == "NI_NUMBER":
        out = F.filter(out, lambda x: ni_allowed(x["phrase"]))
    return out


def rule_spans(text: Column, rule: Rule) -> Column:
    """A rule's evidence in a text, by position."""
    return _kept(find_spans(text, rule.search, _cue(text, rule), context=0, probe=False), rule)


def rule_evidence(text: Column) -> Column:
    """All evidence of a text: the rules in order, then the contextual ones.
    A labelled number counts only where no rule found the same span."""
    rules = (*RULES, NHS_CONTEXT, ADDRESS_LEAD)

    def collected(found: Column) -> Column:
        *plain, context, address = (_kept(F.get(found, F.lit(i)), r) for i, r in enumerate(rules))

        def both(own: Column) -> Column:
            fresh = F.filter(context, lambda x: ~F.exists(own, lambda y: (y["category"] == "NHS_NUMBER") & (y["start"] == x["start"]) & (y["end"] == x["end"])))
            return F.concat(own, fresh)

        return F.concat(let(F.concat(*plain), both), address)

    return let(find_each(text, [(r.search, _cue(text, r)) for r in rules]), collected)


def evidence_in(text: Column) -> Column:
    """``rule_evidence``, found by batches in texts of ASCII alone."""
    from inkwell.operators import batches

    return batches.evidence_in(text, rule_evidence(text))


def detect(notes: DataFrame, key: str = "doc_id", text: str = "text", stage: str = "rules") -> DataFrame:
    """One row for each piece of evidence: key, seq, category, start, end,
    phrase, confidence, stage. Offsets count code points."""
    each = notes.select(F.col(key).alias("doc_id"), evidence_in(F.col(text)).alias("_e"))
    # Exploded as an expression: Spark would filter a column first, and find it twice.
    found = each.select("doc_id", F.posexplode(F.coalesce("_e", F.array().cast(EVIDENCE))).alias("seq", "e"))
    return found.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "e.category", "e.start", "e.end", "e.phrase", "e.confidence", F.lit(stage).alias("stage"))


def combined(*parts: DataFrame) -> DataFrame:
    """Evidence of several stages, one behind the other: sequence numbers of a
    later part come after all of an earlier one's."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("seq", F.col("seq") + F.lit(i << 40).cast("bigint"))
        out = p if out is None else out.unionByName(p)
    return out


def output_offsets(evidence: DataFrame, notes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds byte and UTF-16 offsets to the code-point ones."""
    joined = evidence.join(notes.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    part = lambda c: F.substring(F.col("_text"), F.lit(1), F.col(c))
    units = lambda c: (F.octet_length(F.encode(part(c), "UTF-16BE")) / 2).cast("int")
    return joined.select(*evidence.columns, *[f(c).alias(f"{c}_{n}") for n, f in (("byte", lambda c: F.octet_length(part(c))), ("utf16", units)) for c in ("start", "end")])
