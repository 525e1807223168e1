"""Secret scanning with one combined deterministic automaton over the bytes of each text.

The screens of all rules are compiled into a single minimal automaton, which reads every byte once and says
which rules occur. Only for those rules are spans then fixed: leftmost first, as long as possible, without
overlap within a kind. A match whose run of value characters is too short is consumed but not reported.

Null texts count as empty: no spans. Spans are in code points with an exclusive end, ordered by start and then
by the rules' order. Null ids and repeated rows are kept as they are; one output row per input row, none for an empty
table. Very long texts are scanned whole, as one Arrow value.
"""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tempestry.llm.automata import compile_patterns
from tempestry.llm.common import text_function


@dataclass(frozen=True)
class Rule:
    """kind: name; a match is lead, then a run of characters of the class run; need: run length to report.

    screen: so many run characters already make the automaton look closer (a value up to need).
    """

    kind: str
    lead: str
    run: str
    need: int
    ignore_case: bool = False
    screen: int = 1

    @property
    def full(self):
        return self.lead + self.run + "+"


#: The base kinds, in the order in which they are listed, then common credential formats.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=-]",
        8,
        ignore_case=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, screen=12),
)
MORE_RULES = (
    Rule("bearer", r"bearer\x20+", "[A-Za-z0-9._~+/=-]", 20, ignore_case=True),
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY", "[-]", 5),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 16),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 16),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """The combined automaton of the screens, and per rule those that fix a match's ends."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.combined = compile_patterns(
            [(f"{r.lead}{r.run}{{{min(r.screen, max(r.need, 1))}}}", r.ignore_case) for r in rules], search=True
        )
        own = [(r.full, r.ignore_case) for r in rules]
        self.search = [compile_patterns([p], search=True) for p in own]
        self.back = [compile_patterns([p], reverse=True) for p in own]
        self.whole = [compile_patterns([p]) for p in own]
        self.lead = [compile_patterns([(r.lead, r.ignore_case)]) for r in rules]

    def matches(self, rule, data):
        """(start, end) in bytes of one rule's reported matches."""
        at, end, found = 0, len(data), []
        search, back, whole, lead = self.search[rule], self.back[rule], self.whole[rule], self.lead[rule]
        need = self.rules[rule].need
        while (stop := search.first_end(data, at, end)) >= 0:
            start = back.earliest(data, stop, at)
            stop = whole.longest(data, start, end)
            if stop - lead.longest(data, start, stop) >= need:
                found.append((start, stop))
            at = stop
        return found

    def spans(self, data):
        """(kind, start, end) in code points."""
        seen = self.combined.seen(data)
        if not seen:
            return []
        found = sorted(
            (start, rule, end)
            for rule in range(len(self.rules))
            if seen >> rule & 1
            for start, end in self.matches(rule, data)
        )
        marks, points, last, point = {}, sorted({x for s, _, e in found for x in (s, e)}), 0, 0
        for x in points:
            point += len(data[last:x].decode())
            marks[x], last = point, x
        return [(self.rules[rule].kind, marks[start], marks[end]) for start, rule, end in found]


def find_secrets(text: Column, rules=RULES) -> Column:
    """The spans of all rules in a text column, as array<struct<kind, start, end>>."""
    scanner = Scanner(rules)

    def make():
        def work(texts):
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t)] if t else [] for t in texts
            ]
            return pa.array(rows, SPAN_TYPE)

        return work

    return text_function(make, SPANS, "find_secrets")(text)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every stretch covered by spans replaced by `<kind>` of the span that begins it.

    Overlapping spans make one stretch. A text without spans, and a null text, stay as they are.
    """
    # Fold the ordered spans into disjoint stretches, then cut the text between them.
    merged = F.aggregate(
        spans,
        F.array().cast(SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["kind"].alias("kind"),
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    cut = F.aggregate(
        merged,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at")),
        lambda done, s: F.struct(
            F.concat(
                done["parts"],
                F.array(
                    F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                    F.concat(F.lit("<"), s["kind"], F.lit(">")),
                ),
            ).alias("parts"),
            s["end"].alias("at"),
        ),
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)
