"""Personal data by weak supervision.

Base patterns with their checks always count. Everything that looks like
personal data is a candidate: base spans, what nearly is one (a card number that
fails its check digit, an address with a part over 255, a phone number with too
few digits, an e-mail address without a dot or with its signs spelled out), and
wider kinds. On every candidate five labelers vote yes, no or abstain: its form,
its check (digits, ranges), a gazetteer, the words around it, and its place
(no if it is glued to other text). Expectation-maximisation over the counts of
vote patterns estimates for each family of kinds, base spans included, how
reliable its labelers are, without any labels; its posteriors train a logistic
span classifier over what the labelers saw and the span's shape, which decides
about all that isn't base. Only counts of patterns leave the executors.

People are proposed by shape and place: capitalised words behind a title or a
word such as "contact", or behind a common given name. A list alone decides
nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.spans import find_spans, let

from .common import written

_DIGITS = "[^0-9]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    cue: str
    strict: str
    gazetteer: str
    context: str
    #: What the strict labeler denies; without either it abstains.
    deny: str = "$^"
    #: Whether the gazetteer has all there are, so that what it lacks is denied.
    closed: bool = False

    @property
    def family(self) -> str:
        """Kinds that share reliabilities and weights."""
        return self.name.removeprefix("maybe_")


# Cues, given names, countries and issuers of the labelers.
NAMES = "Alice|Anna|Carlos|Charles|David|Elena|Elizabeth|Emma|Fatima|George|Hans|James|Jean|John|Jose|Julia|Karl|Laura|Luis|Maria|Mary|Michael|Mohammed|Olivia|Pablo|Patricia|Paul|Peter|Pierre|Robert|Sarah|Sofia|Susan|Thomas|William"
# Titles, what stands before a name, and what isn't one though it is capitalised.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora"
BEFORE = "name is|[Ss]igned|[Cc]ontact|[Aa]uthor|[Dd]ear|[Rr]egards,|[Ss]incerely,|[Ww]ritten by|[Aa]ttn"
PLACES = "Street|Road|Avenue|Lane|Square|University|College|Hospital|City|River|Park|Company|Office|Department|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September|October|November|December|Us|Customer|Support|Sales|The|This"
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"\.[A-Za-z]{2,}$", r"(?i)\.(?:com|org|net|edu|gov|de|fr|es|uk|info|io)$", r"(?i)(?:e-?mail|mail|contact|write|correo)"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]+\.[0-9]", r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$", r"^(?!0\.)(?!127\.)(?!255\.)", r"(?i)(?:\bip\b|address|host|server|login)"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){12}", r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$", r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])", r"(?i)(?:card|visa|master|credit|pay|tarjeta|karte|carte)"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"^\+[0-9]{1,3}[ (.-]", r"^\+(?:1|33|34|44|49|39|41|43)", r"(?i)(?:phone|tel|call|fax|mobile|cell)"),
)
MORE = (
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:[0-6][0-9]{2}|7[0-6][0-9])", r"(?i)(?:ssn|social|security|taxpayer)", deny=r"^(?:000|666|9)|-00-|-0000$", closed=True),
    Kind("localphone", r"(?<![0-9+().-])(?<![0-9+)][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[.-][0-9]{4}", r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9]", r"^\(?(?:2[0-5]|3[0-3]|4[0-3]|5[0-7]|6[0-4]|7[0-3]|8[0-4]|9[0-4])", r"(?i)(?:phone|tel|call|fax|mobile|cell)", deny=r"^\(?[01]|^\(?[0-9]{3}[) .-]+[01]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})* ?[A-Z0-9]{0,4}$", f"^(?:{COUNTRIES})", r"(?i)(?:iban|account|konto|compte|cuenta|bank)", closed=True),
    Kind(
        "person",
        rf"(?<![A-Za-z])(?:(?:{TITLES})\.? [A-Z][a-z]{{1,20}}+(?: [A-Z][a-z]{{1,20}}+)?+|(?:{NAMES}) [A-Z][a-z]{{2,20}}+|(?<=(?:{BEFORE}) )[A-Z][a-z]{{2,20}}+ [A-Z][a-z]{{2,20}}+)(?![A-Za-z])",
        r"[A-Z][a-zñ]+[.]? [A-Z][a-z]", rf"^(?:{TITLES})[. ]|^[A-Z][a-z]{{2,}} [A-Z][a-z]{{2,}}$", rf"(?:^| )(?:{NAMES})(?: |$)", rf"(?:{BEFORE}|\bby|called|met|wrote) $", deny=rf"(?:^| )(?:{PLACES})(?: |$)",
    ),
)
#: What base patterns find and their checks refuse, and e-mail addresses that
#: the pattern doesn't take.
CHECKED = ("ip", "card", "phone")
NEAR = (
    replace(BASE[0], name="maybe_email", pattern=r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+(?![A-Za-z0-9@-])", cue=r"@|[\[(]at[\])]"),
    *(replace(k, name=f"maybe_{k.name}") for k in BASE if k.name in CHECKED),
)
AGAINST = r"(?i)(?:order|version|part no|item|isbn|serial|figure|section|table)"
KINDS = BASE + NEAR + MORE
FAMILIES = tuple(dict.fromkeys(k.family for k in KINDS))
LABELERS = ("form", "check", "gazetteer", "context", "place")
FEATURES = ("strict", "gazetteer", "for", "against", "split", "ends", "denied", "opens", "passes", "fails", "alone")
ACCEPT = 0.95
#: What is held of a labeler before any span is seen, P(vote | class) for false
#: and true spans: it is better than chance, and a failed check speaks against a
#: span more than others do. It counts as much as HELD spans of each class; and
#: as much as four times all spans of a family where fewer than three labelers
#: vote in more than one way (each way on this share of them), for then agreement
#: can't tell who is right, and spans that were all proposed for one reason
#: would all drift into one class.
GUESS = {name: ((0.4, 0.55, 0.05), (0.35, 0.05, 0.6)) for name in LABELERS} | {"check": ((0.3, 0.65, 0.05), (0.3, 0.02, 0.68))}
HELD, SHARE = 100.0, 0.05
ROUNDS, STEPS, RATE, PENALTY = 100, 800, 0.5, 1e-3
CANDIDATE = "array<struct<order:int,start:int,end:int,kind:string,votes:int,features:int>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, _DIGITS, "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        # An all-zero part leaves nothing for the group after the possessive zeros.
        part = f"(?:{part}|0++)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """The remainder that is 1 for an account number with the right check digits."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    turned = F.filter(F.split(F.upper(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _check(kind: Kind, value: Column) -> Column:
    """Vote of the check: 2 passes, 1 fails, 0 there is none."""
    if kind.family in CHECKED:
        passes = _passes(kind.family, value)
    elif kind.family == "email":
        passes = value.rlike(r"@[^@]*\.[A-Za-z]{2,}$")
    elif kind.family == "iban":
        passes = _mod97(value) == 1
    else:
        return F.lit(0)
    return F.when(passes, 2).otherwise(1)


def _candidate(order: Column, kind: Kind, x: Column) -> Column:
    around = F.concat(x["left"], F.lit(" "), x["right"])
    strict, gazetteer, denied = (x["value"].rlike(p) for p in (kind.strict, kind.gazetteer, kind.deny))
    pro, contra = F.coalesce(x["left"].rlike(kind.context), F.lit(False)), around.rlike(AGAINST)
    alone = x["left"].rlike(r"(?:^|[\s(\[\"':,;>])$") & x["right"].rlike(r"^(?:[\s.,;:!?)\]\"'<]|$)")

    def rated(check: Column) -> Column:
        flags = (strict, gazetteer, pro, contra, x["value"].rlike(r"[ ().-]"), x["right"].rlike(r"^(?:[\s.,;:)]|$)"), denied, x["left"].rlike(r"(?:^|[.!?:\n]\s*)$"), check == 2, check == 1, alone)
        # Votes in base three: 0 abstains, 1 says no, 2 says yes.
        votes = (
            F.when(denied, 1).when(strict, 2).otherwise(0),
            check,
            F.when(gazetteer, 2).otherwise(1 if kind.closed else 0),
            F.when(pro & ~contra, 2).when(contra & ~pro, 1).otherwise(0),
            F.when(alone, 0).otherwise(1),
        )
        code = sum((v * 3**j for j, v in enumerate(votes)), F.lit(0))
        bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
        # A base pattern's match that fails its check is of the kind beside it.
        near = kind.name in CHECKED
        place = F.when(check == 2, order).otherwise(order + len(BASE)) if near else order
        name = F.when(check == 2, kind.name).otherwise(f"maybe_{kind.name}") if near else F.lit(kind.name)
        return F.struct(place.cast("int").alias("order"), x["start"].alias("start"), x["end"].alias("end"), name.alias("kind"), code.cast("int").alias("votes"), bits.cast("int").alias("features"))

    return let(_check(kind, x["value"]), rated)


def _found(text: Column, order: int, kind: Kind) -> Column:
    cue = text.rlike(kind.cue) if any(c in kind.cue for c in "[(") else text.contains(kind.cue)
    spans = find_spans(text, kind.pattern, cue)
    if kind.name == "maybe_email":
        spans = F.filter(spans, lambda x: ~x["value"].rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))
    return F.transform(spans, lambda x: _candidate(F.lit(order), kind, x))


def candidates(text: Column) -> Column:
    """Base spans and proposed spans of a text, by kind as listed, then start."""
    searched = [(i, k) for i, k in enumerate(KINDS) if not (k in NEAR and k.family in CHECKED)]
    return F.sort_array(F.concat(*[_found(text, i, k) for i, k in searched]))


def votes_of(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(len(LABELERS))]


def fit_labelers(counts: dict[int, float]) -> tuple[float, list[list[list[float]]]]:
    """EM for two latent classes. ``counts``: spans for each vote pattern.
    Returns the share of true spans and P(vote | class) of each labeler."""
    split = {v: votes_of(v) for v in counts}
    total = sum(counts.values())
    prior, chance = 0.5, [[list(c) for c in GUESS[name]] for name in LABELERS]
    ways = [sum(sum(n for v, n in counts.items() if split[v][j] == vote) > SHARE * total for vote in range(3)) for j in range(len(LABELERS))]
    held = HELD + (4 * total if sum(w > 1 for w in ways) < 3 else 0)
    for _ in range(ROUNDS):
        sums = [[[held * x for x in c] for c in GUESS[name]] for name in LABELERS]
        yes = held / 2
        for v, n in counts.items():
            q = posterior(prior, chance, split[v])
            yes += n * q
            for j, vote in enumerate(split[v]):
                sums[j][1][vote] += n * q
                sums[j][0][vote] += n * (1 - q)
        prior = yes / (total + held)
        chance = [[[x / sum(c) for x in c] for c in s] for s in sums]
    return prior, chance


def posterior(prior: float, chance: list[list[list[float]]], votes: list[int]) -> float:
    log = math.log(prior / (1 - prior)) + sum(math.log(chance[j][1][v] / chance[j][0][v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))


def fit_classifier(rows: list[tuple[str, int, float, float]]) -> dict[str, float]:
    """Logistic regression over (family, feature bits, weight, target)."""
    names = [f"kind:{k}" for k in FAMILIES] + list(FEATURES) + ["bias"]
    at = {n: i for i, n in enumerate(names)}
    data = [([at[f"kind:{k}"], at["bias"], *(at[f] for i, f in enumerate(FEATURES) if bits >> i & 1)], n, y) for k, bits, n, y in rows]
    total, w = sum(n for _, n, _ in data) or 1.0, [0.0] * len(names)
    for _ in range(STEPS if data else 0):
        grad = [PENALTY * x for x in w]
        for active, n, y in data:
            error = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in active))))) - y)
            for i in active:
                grad[i] += error
        w = [x - RATE * g for x, g in zip(w, grad, strict=True)]
    return dict(zip(names, w, strict=True))


def learn(found: DataFrame) -> dict[str, float]:
    """Weights from all candidates, base spans among them. What reaches the
    driver are counts of (family, votes, features): a fixed number at most."""
    each = found.select(F.explode("candidates").alias("c"))
    got = each.groupBy(F.regexp_replace("c.kind", "^maybe_", "").alias("family"), "c.votes", "c.features").count().collect()
    return weights_of(sorted((r["family"], r["votes"], r["features"], float(r["count"])) for r in got))


def weights_of(got: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Classifier weights from counts of (family, votes, features)."""
    rows = []
    for family in FAMILIES:
        own = [x for x in got if x[0] == family]
        counts: dict[int, float] = {}
        for _, votes, _, n in own:
            counts[votes] = counts.get(votes, 0.0) + n
        prior, chance = fit_labelers(counts)
        total = sum(counts.values())
        # Families weigh alike, however unlike their numbers.
        rows += [(family, bits, n / total, posterior(prior, chance, votes_of(votes))) for _, votes, bits, n in own]
    return fit_classifier(rows)


def accepted(weights: dict[str, float], threshold: float = ACCEPT):
    """A condition on a candidate: a base span, or one that the classifier takes."""
    limit = math.log(threshold / (1 - threshold))

    def test(c: Column) -> Column:
        score = F.lit(weights.get("bias", 0.0))
        for kind in KINDS:
            score = score + F.when(c["kind"] == kind.name, weights.get(f"kind:{kind.family}", 0.0)).otherwise(0.0)
        for i, f in enumerate(FEATURES):
            score = score + F.when(F.getbit(c["features"], F.lit(i)) == 1, weights.get(f, 0.0)).otherwise(0.0)
        return (c["order"] < len(BASE)) | (score >= limit)

    return test


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """``key`` and ``spans`` for every row of ``docs``.

    A proposed span that overlaps a base span is dropped, one that the
    classifier doubts too. Null and empty texts have no spans; a corpus without
    candidates yields none; repeated rows are treated alike.
    """
    found = written(docs.select(F.col(key), candidates(F.coalesce(F.col(text), F.lit(""))).alias("candidates")), "pii")
    takes = accepted(learn(found), threshold)
    base = F.filter("candidates", lambda c: c["order"] < len(BASE))
    clear = F.filter("candidates", lambda c: takes(c) & ((c["order"] < len(BASE)) | ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    return found.select(F.col(key), clear.alias("spans"))
