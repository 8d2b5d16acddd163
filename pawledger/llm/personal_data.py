"""Personal data in texts by weak supervision; DataFrame functions only.

Base spans are what fixed patterns and their checks accept. Looser patterns propose further
candidates in what is left of the text. For each candidate, labelers vote that it is personal data,
that it is none, or abstain: the form of the match, its check digits, word lists (endings of
domains, calling codes, issuers, given names), the words before it, how its digits vary, and whether
it stands alone. Expectation-maximisation over the counts of all vote patterns estimates how
reliable each labeler is. The posteriors train the span classifier, a logistic regression on the
votes, the kind and the surroundings, which accepts or rejects every candidate that is not base.

Patterns begin only where a run of their characters begins, and inner groups are possessive, so each
takes time in proportion to the text and no deep recursion. A position is the sum of the lengths of
the parts before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .columns import let, upto
from .quality_rules import ABSTAINS, BAD, GOOD, estimate, posterior
from .store import stored

#: Marks the ends of matches; in texts it counts as MASK.
CUT, MASK = "\x03", "\x02"
CONTEXT_CHARS = 40
LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@{LABEL}(?:\.{LABEL})++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
MARKED_AT, MARKED_DOT = r"[(\[](?:at|AT)[)\]]", r"(?:[(\[](?:dot|DOT)[)\]]|\.)"
WRITTEN = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++ ?{MARKED_AT} ?{LABEL}(?: ?{MARKED_DOT} ?{LABEL})++"
NUMBER = r"(?<![0-9A-Za-z.+/-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])"
ACCOUNT = r"(?<![0-9])(?:(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{13,19})(?![0-9])"

# Word lists of the gazetteer labelers.
GIVEN_NAMES = (
    "Alexander", "Alice", "Andrea", "Andrew", "Anna", "Anthony", "Barbara", "Brian", "Carlos", "Carmen", "Catherine", "Charles",
    "Charlotte", "Christine", "Christopher", "Daniel", "David", "Elena", "Elizabeth", "Emily", "Emma", "Francesca", "George",
    "Hannah", "Helen", "Isabel", "Jacques", "James", "Jennifer", "Jessica", "John", "Jonathan", "Joseph", "Juan", "Julia",
    "Karen", "Karl", "Katharina", "Laura", "Linda", "Lucas", "Manuel", "Margaret", "Maria", "Martin", "Mary", "Matthew",
    "Michael", "Nicolas", "Nina", "Oliver", "Patricia", "Paul", "Peter", "Pierre", "Rachel", "Rebecca", "Richard", "Robert",
    "Sandra", "Sarah", "Sophie", "Stefan", "Stephen", "Susan", "Thomas", "Ursula", "Victoria", "William", "Wolfgang",
)
DOMAIN_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "es", "fr", "it", "nl", "uk", "eu", "us", "ca", "ch", "at", "be", "mx", "ar", "br", "in", "jp", "cn", "au")
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z])(?:{'|'.join(GIVEN_NAMES)}) \p{{Lu}}\p{{Ll}}++(?![\p{{L}}\p{{N}}])"
#: Words before a span that speak for personal data, and against it.
FOR_WORDS = "phone|tel|telephone|call|fax|mobile|cell|mail|email|e-mail|contact|write|reach|card|visa|mastercard|payment|account|address|login|name|mr|mrs|ms|dr"
AGAINST_WORDS = "version|isbn|order|invoice|sku|part|serial|build|release|page|chapter|section|figure|table|item|ticket|total|sum"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def octets(match: Column) -> Column:
    """The parts of an address without leading zeros."""
    return F.transform(F.split(match, "\\."), lambda part: F.ltrim(part, F.lit("0")))


def small_octets(match: Column) -> Column:
    return F.forall(octets(match), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def count_between(match: Column, low: int, high: int) -> Column:
    return F.length(digits_of(match)).between(low, high)


def voted(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAINS)


def either(good: Column) -> Column:
    return F.when(good, GOOD).otherwise(BAD)


def known_ending(match: Column) -> Column:
    ending = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
    return either(ending.isin(*DOMAIN_ENDINGS))


def checked_digits(match: Column) -> Column:
    return either(count_between(match, 12, 19) & luhn(digits_of(match)))


def issuer(match: Column) -> Column:
    return either(digits_of(match).rlike("^[3-6]"))


def varied(match: Column) -> Column:
    """Few different digits, as in made-up numbers, speak against a span."""
    kinds = F.size(F.array_distinct(F.split(digits_of(match), "(?<=.)(?=.)")))
    return F.when(kinds <= 2, BAD).when(kinds >= 5, GOOD).otherwise(ABSTAINS)


def nothing(match: Column) -> Column:
    return F.lit(ABSTAINS)


def says_yes(match: Column) -> Column:
    return F.lit(GOOD)


@dataclass(frozen=True)
class Kind:
    """A pattern, what a match must pass, a cheap test of texts, and the votes on a match itself."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    passes: Callable[[Column], Column]
    form: Callable[[Column], Column]
    check: Callable[[Column], Column] = nothing
    listed: Callable[[Column], Column] = nothing
    digits: Callable[[Column], Column] = nothing


def anything(match: Column) -> Column:
    return F.lit(True)


BASE = (
    Kind("email", EMAIL, lambda t: t.contains("@"), anything, says_yes, listed=known_ending),
    Kind(
        "ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), small_octets, says_yes, check=lambda m: either(small_octets(m)),
        listed=lambda m: either(~m.rlike(r"^0*(?:0|127|255)\.")), digits=varied,
    ),
    Kind(
        "card", CARD, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){11}"), lambda m: count_between(m, 12, 19) & luhn(digits_of(m)),
        says_yes, checked_digits, issuer, varied,
    ),
    Kind(
        "phone", PHONE, lambda t: t.contains("+"), lambda m: count_between(m, 9, 15), says_yes,
        listed=lambda m: either(~m.rlike(r"^\+0")), digits=varied,
    ),
)
#: Looked for where no base span lies.
FURTHER = (
    Kind("written", WRITTEN, lambda t: t.rlike(MARKED_AT), anything, nothing, listed=known_ending),
    Kind(
        "number", NUMBER, lambda t: t.rlike("[0-9][ .-][0-9]{3}"), anything,
        lambda m: voted(m.rlike("[(+]"), ~m.rlike("[(+.-]")), lambda m: either(count_between(m, 9, 15)), digits=varied,
    ),
    Kind("account", ACCOUNT, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), anything, nothing, checked_digits, issuer, varied),
    Kind("person", PERSON, lambda t: F.lit(True), anything, nothing, listed=says_yes),
)
KINDS = BASE + FURTHER
LABELERS = ("form", "check", "listed", "digits", "context", "alone")
#: Lengths that are added up in one block.
SUMMED = 512
#: Candidates of a kind in one text from which it counts as a list of them.
MANY = 20
THRESHOLD = 0.5
EMPTY = "array<struct<kind:int,start:int,end:int,votes:array<int>,long:int,many:int>>"


def parts_of(text: Column, kind: Kind) -> Column:
    """The text in parts: the odd ones are matches of the kind's pattern."""
    return F.split(F.regexp_replace(text, kind.pattern, f"{CUT}$0{CUT}"), CUT)


def sums_before(lengths: Column) -> Column:
    """For each length the sum of all before it, block by block."""

    def inside(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before"))
        return F.aggregate(block, start, step)

    def joined(blocks: Column) -> Column:
        shifts = inside(F.transform(blocks, lambda b: b["sum"]))["before"]
        shifted = let(shifts, lambda s: F.transform(blocks, lambda b, k: F.transform(b["before"], lambda x: x + F.get(s, k))))
        return F.flatten(shifted)

    whole = F.transform(
        upto(F.ceil(F.size(lengths) / SUMMED).cast("int")), lambda k: inside(F.slice(lengths, k * SUMMED + 1, SUMMED))
    )
    return F.when(F.size(lengths) <= SUMMED, inside(lengths)["before"]).otherwise(let(whole, joined))


def matches(parts: Column) -> Column:
    return F.floor(F.size(parts) / 2).cast("int")


def context_vote(before: Column) -> Column:
    near = F.lower(F.right(before, F.lit(CONTEXT_CHARS)))
    word = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
    return voted(near.rlike(word % FOR_WORDS), near.rlike(word % AGAINST_WORDS))


def alone(before: Column, after: Column) -> Column:
    joined = before.rlike(r"[\p{L}\p{N}_/=.-]$") | after.rlike(r"^(?:[\p{L}\p{N}_/=@]|[.-][\p{L}\p{N}])")
    return either(~joined)


def candidates(text: Column, kind: Kind) -> Column:
    """The matches that pass, with their places (from 0, end exclusive) and votes."""

    def found(parts: Column) -> Column:
        def places(at: Column) -> Column:
            def one(k: Column) -> Column:
                here = 2 * k + 1
                before, match, after = F.get(parts, here - 1), F.get(parts, here), F.get(parts, here + 1)
                start = F.get(at, here)
                own = [kind.form(match), kind.check(match), kind.listed(match), kind.digits(match)]
                votes = F.array(*[v.cast("int") for v in (*own, context_vote(before), alone(before, after))])
                return F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"),
                    start.alias("start"),
                    (start + F.length(match)).alias("end"),
                    votes.alias("votes"),
                    (F.length(match) > 24).cast("int").alias("long"),
                    (matches(parts) >= MANY).cast("int").alias("many"),
                )

            good = F.filter(upto(matches(parts)), lambda k: kind.passes(F.get(parts, 2 * k + 1)))
            return F.transform(good, one)

        some = let(let(F.transform(parts, F.length), sums_before), places)
        return F.when(F.size(parts) > 1, some).otherwise(F.array().cast(EMPTY))

    return F.when(kind.gate(text), let(parts_of(text, kind), found)).otherwise(F.array().cast(EMPTY))


def masked(text: Column, kind: Kind) -> Column:
    """The text with MASK for each character of the kind's spans."""

    def hidden(part: Column, k: Column) -> Column:
        return F.when((k % 2 == 1) & kind.passes(part), F.repeat(F.lit(MASK), F.length(part))).otherwise(part)

    whole = let(parts_of(text, kind), lambda parts: F.array_join(F.transform(parts, hidden), ""))
    return F.when(kind.gate(text), whole).otherwise(text)


def all_candidates(text: Column) -> Column:
    """The candidates of all kinds; further kinds look at the text without base spans."""

    def further(rest: Column, hide: tuple) -> Column:
        if hide:
            return let(masked(rest, hide[0]), lambda shorter: further(shorter, hide[1:]))
        return F.concat(*[candidates(rest, kind) for kind in FURTHER])

    email, ip, card, phone = BASE
    return F.concat(*[candidates(text, kind) for kind in BASE], further(text, (email, phone, card, ip)))


def proposed(documents: DataFrame) -> DataFrame:
    """doc_id and the candidates of all kinds for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.when(text.contains(CUT), F.translate(text, CUT, MASK)).otherwise(text)
    return documents.select("doc_id", let(clean, all_candidates).alias("found"))


def indexes(kind: Column, votes: Column, long: Column, many: Column) -> list[Column]:
    """Where a candidate's features stand in the classifier's weights."""
    n = len(KINDS)
    places = [kind, *[n + 3 * k + F.get(votes, F.lit(k)) for k in range(len(LABELERS))]]
    return [*places, n + 3 * len(LABELERS) + long, n + 3 * len(LABELERS) + 2 + many]


WIDTH = len(KINDS) + 3 * len(LABELERS) + 4


def trained(patterns: list[tuple[tuple, int]], rounds: int = 25) -> list[float]:
    """Weights of the span classifier, from ((kind, votes, long, many), how many spans have them).

    Its targets are the posteriors of the labelers' votes; Newton steps with a small penalty.
    """
    by_votes: dict[tuple, int] = {}
    for (_, votes, _, _), n in patterns:
        by_votes[votes] = by_votes.get(votes, 0) + n
    share, table = estimate(sorted(by_votes.items()), len(LABELERS))
    rows, target, weight = np.zeros((len(patterns), WIDTH)), np.zeros(len(patterns)), np.zeros(len(patterns))
    for i, ((kind, votes, long, many), n) in enumerate(patterns):
        n_kinds, end = len(KINDS), len(KINDS) + 3 * len(LABELERS)
        rows[i, [kind, *[n_kinds + 3 * k + v for k, v in enumerate(votes)], end + long, end + 2 + many]] = 1
        target[i], weight[i] = posterior(votes, share, table), n
    found = np.zeros(WIDTH)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        slope = rows.T @ (weight * (target - p)) - found
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.eye(WIDTH)
        found = found + np.linalg.solve(bend, slope)
    return found.tolist()


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base, score), sorted by start and kind, for each row.

    Base spans stay whatever their score; others need a score of THRESHOLD. Kinds are those of
    KINDS, start and end are code points (end exclusive). Whole texts are used; a null or empty text
    has no spans. Spans of one kind never overlap, and further kinds don't overlap base spans.
    Repeated rows are each judged; ids play no part and may be null; further columns play no part.
    An empty table gives no rows. The driver gets one count for each pattern of a kind and its
    votes, of which there are at most len(KINDS) * 3 ** len(LABELERS) * 4.
    """
    rows = stored(proposed(documents), "personal-data")
    one = rows.select(F.inline("found"))
    counts = one.groupBy("kind", "votes", "long", "many").count().collect()
    patterns = sorted(((r["kind"], tuple(r["votes"]), r["long"], r["many"]), r["count"]) for r in counts)
    weights = F.array(*[F.lit(w) for w in trained(patterns)])

    def scored(c: Column) -> Column:
        places = indexes(c["kind"], c["votes"], c["long"], c["many"])
        odds = sum((F.get(weights, place) for place in places[1:]), F.get(weights, places[0]))
        score = 1 / (1 + F.exp(-odds))
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), (c["kind"] < len(BASE)).alias("base"), score.alias("score"))

    spans = F.filter(F.transform("found", scored), lambda s: s["base"] | (s["score"] >= THRESHOLD))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    named = F.transform(F.sort_array(spans), lambda s: s.withField("kind", F.get(names, s["kind"])))
    return rows.select("doc_id", named.alias("spans"))
