"""The document-local engine: detect, veto, trim, resolve, recover, residual cells, sweep. Pure Python, run in Arrow batches."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field, replace
from functools import lru_cache

from umbra.functions import text as tx
from umbra.functions.validators import NORMALIZERS, VALIDATORS
from umbra.operators.rules import CORE, Rule, admitted, compile_pattern

CLASS_PRIORITY = {"email": 90, "name": 80, "organization": 70, "location": 60}
LEARNED, PATTERN, ANCHORED, VALIDATED = range(4)
CUE_WINDOW, MAX_GROUPS, MAX_EXTRA = 64, 4, 40


@dataclass(frozen=True)
class Candidate:
    """A detected span; offsets are characters of the detection view until the document is done, then UTF-8 bytes."""

    start: int
    end: int
    cls: str
    rule: str
    score: float = 0.7
    priority: int = 80
    canonical: str | None = None
    evidence: str = "rule"
    family: str | None = None
    variant: str | None = None
    precedence: int = 0
    anchors: tuple[str, ...] = ()
    reason: str | None = None
    decided_by: str = "none"
    merged: tuple[str, ...] = ()
    rejected: bool = False
    scan: str | None = None

    @property
    def tier(self) -> int:
        if self.evidence != "rule":
            return LEARNED
        return VALIDATED if self.canonical else ANCHORED if self.anchors else PATTERN


@dataclass
class Pool:
    live: list[Candidate] = field(default_factory=list)
    vetoed: list[Candidate] = field(default_factory=list)


def class_rank(cls: str) -> int:
    return CLASS_PRIORITY.get(cls, 50)


def order_key(c: Candidate):
    return c.start, -c.end, -class_rank(c.cls), -c.priority, -c.score, c.rule


@lru_cache(maxsize=512)
def _compiled(pattern: str):
    return compile_pattern(pattern)


_MORE = re.compile(r"[ ./_:-]{1,3}([A-Z0-9]+)(?![A-Za-z0-9])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
#: Words that name the next field of a record.
FIELD_WORDS = {"SSN", "TIN", "DOB", "ID", "TAX", "UTR", "TFN", "EXP", "VALID"}
_FIELD = re.compile(r"[A-Z]{2,}(?: [A-Z]{2,}){0,3} *[:=#|,;-]")


def _complete(text: str, start: int, end: int) -> tuple[int, str | None]:
    """A labelled value goes on over value-like groups, up to a date or the next field's label; a long one is noted."""
    now, why = end, None
    while m := _MORE.match(text, now):
        if _DATE.match(text, m.start(1)):
            why = "date_boundary"
            break
        if m[1] in FIELD_WORDS or _FIELD.match(text, m.start(1)):
            why = "label_boundary"
            break
        if not (any(c.isdigit() for c in m[1]) or m[1].isupper()):
            break
        now = m.end()
    groups = len(re.findall("[A-Za-z0-9]+", text[start:now]))
    if now - start > MAX_EXTRA or groups > MAX_GROUPS:
        return now, "too_long"
    return now, why or ("completed" if now > end else None)


_DIGITS = re.compile("[0-9]+")
#: Digits by group in which card numbers are printed.
LAYOUTS = {*((n,) for n in range(13, 20)), (4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}


def card_spans(run: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(cards, failures) in a run of digits with single separators: windows of whole groups that hold 13 to 19 digits,
    from left to right, and windows in a card's layout. Of those that pass Luhn overlapping ones make one span;
    failures are the plain windows that touch no card."""
    groups = [m.span() for m in _DIGITS.finditer(run)]
    sizes = [b - a for a, b in groups]
    plain, i = [], 0
    while i < len(groups):
        fits = [j for j in range(i, min(len(groups), i + 19)) if 13 <= sum(sizes[i : j + 1]) <= 19]
        if fits:
            plain.append((groups[i][0], groups[fits[-1]][1]))
        i = fits[-1] + 1 if fits else i + 1
    printed = [(groups[i][0], groups[i + n - 1][1]) for i in range(len(groups)) for n in range(1, 6) if tuple(sizes[i : i + n]) in LAYOUTS and i + n <= len(groups)]
    cards: list[tuple[int, int]] = []
    for a, b in sorted(w for w in {*plain, *printed} if VALIDATORS["luhn"](run[w[0] : w[1]])[0]):
        if cards and a < cards[-1][1]:
            cards[-1] = (cards[-1][0], max(b, cards[-1][1]))
        else:
            cards.append((a, b))
    return cards, [w for w in plain if not any(w[0] < b and a < w[1] for a, b in cards)]


_RUN_AFTER = re.compile(r"[^\W_]*[0-9_]")
_ZERO_COUNTRY = re.compile(r"\+[\t -]*0[0-9 \t./()-]*$")
_SKU = re.compile(r"(?i)(?<![\w-])sku-[\w-]*$")


def _guarded(rule: Rule, text: str, start: int, end: int) -> bool:
    """A context in which the match is part of something else."""
    if rule.word_run and _RUN_AFTER.match(text, end):
        return True
    if rule.zero_country and text[start] != "+" and _ZERO_COUNTRY.search(text, max(0, start - 32), start):
        return True
    if rule.sku and (m := _SKU.search(text, max(0, start - 256), start)):
        return any(c.isalpha() for c in m[0][4:])
    return False


def possible(rule: Rule, text: str, low: str, digit: bool) -> bool:
    """Whether the literals without which the rule can't match are there."""
    return (digit or not rule.digits) and all(n in text for n in rule.needs) and (not rule.hints or any(h in low for h in rule.hints))


def scan_rule(rule: Rule, text: str, low: str | None = None, digit: bool = True) -> list[Candidate]:
    """Matches of one rule; the search goes on at the end of the capture, and a match without one is skipped whole."""
    if not possible(rule, text, text.lower() if low is None else low, digit):
        return []
    found, at, pattern = [], 0, _compiled(rule.pattern)
    reject = _compiled(rule.reject) if rule.reject else None
    plain = Candidate(0, 0, rule.cls, rule.id, rule.base, rule.priority, None, "rule", rule.family, rule.variant, rule.precedence, rule.anchors)
    while m := pattern.search(text, at):
        span = next((m.span(g) for g in rule.groups if m.span(g)[0] >= 0 and m.span(g)[0] < m.span(g)[1]), None)
        if span is None:
            at = max(m.end(), at + 1)
            continue
        start, end = span
        at = max(end, at + 1)
        if any(x in m[0].lower() for x in rule.exclusions) or _guarded(rule, text, start, end):
            continue
        if rule.card_run:
            cards, failed = card_spans(text[start:end])
            found += [replace(plain, start=start + a, end=start + b, canonical="".join(_DIGITS.findall(text[start + a : start + b]))) for a, b in cards]
            found += [replace(plain, start=start + a, end=start + b, reason="checksum") for a, b in failed]
            continue
        scan = None
        if rule.complete:
            end, scan = _complete(text, start, end)
        value = text[start:end]
        c = replace(plain, start=start, end=end, scan=scan, rejected=bool(reject and reject.fullmatch(value)))
        if rule.validator and not c.rejected:
            ok, canonical, reason = VALIDATORS[rule.validator](value)
            if ok:
                c = replace(c, canonical=NORMALIZERS[rule.normalizer](value) if rule.normalizer else canonical)
            else:
                c = replace(c, reason=reason) if rule.on_fail == "veto" else replace(c, reason=reason, evidence="learned", scan="recorded")
        found.append(c)
    return found


def scan_dictionary(name: str, terms: list[str], cls: str, text: str, case_sensitive: bool = True, whole: bool = True) -> list[Candidate]:
    """Terms at token boundaries: no letter, digit or underscore beside them, nor a hyphen that joins one; longest first."""
    import ahocorasick

    key = (tuple(terms), case_sensitive)
    if key not in _AUTOMATA:
        automaton = ahocorasick.Automaton()
        for t in terms:
            if t:
                automaton.add_word(t if case_sensitive else t.lower(), t)
        automaton.make_automaton()
        _AUTOMATA[key] = automaton
    body = text if case_sensitive or len(text.lower()) != len(text) else text.lower()
    if not len(_AUTOMATA[key]):
        return []
    joins = lambda i, step: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_" or text[i] == "-" and 0 <= i + step < len(text) and text[i + step].isalnum())
    hits = sorted(((e - len(t) + 1, e + 1) for e, t in _AUTOMATA[key].iter(body)), key=lambda s: (s[0], -s[1]))
    out, at = [], -1
    for a, b in hits:
        if a >= at and not (whole and (joins(a - 1, -1) or joins(b, 1))):
            out.append(Candidate(a, b, cls, f"dictionary.{name}", 0.9, 95, text[a:b]))
            at = b
    return out


_AUTOMATA: dict = {}
_PERSON = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau)\.? )?[A-ZÀ-ÖØ-Þ][\w'’-]*(?: (?:(?:von|van|de|der|den|da|di|del|zu|la|le) )*[A-ZÀ-ÖØ-Þ][\w'’-]*){0,3}")


@dataclass(frozen=True)
class Anchored:
    """Cue phrases beside which a person's name stands, within so many characters and up to a kind of boundary."""

    id: str
    cues: dict[str, tuple[str, ...]]
    window: int
    boundary: str = "punctuation"
    side: str = "before"
    base: float = 0.88
    priority: int = 110


#: Cue phrases by language.
ANCHORED = (
    Anchored("name.forward_marker", {"en": ("forwarded message from", "begin forwarded message", "----- forwarded message", "forwarded by"), "de": ("weitergeleitete nachricht von", "weitergeleitet von", "forwarded message from", "----- forwarded message")}, 64),
    Anchored("name.agent_recipient", {"en": ("reply to", "respond to", "draft for", "draft to", "dear", "hello"), "de": ("antwortest", "antworte", "schreibst", "sehr geehrte", "sehr geehrter", "liebe", "lieber", "reply to", "respond to", "draft for", "draft to")}, 48),
    Anchored("name.auto_footer", {"en": ("sent by", "sent via", "on behalf of", "regards,", "best wishes,", "sincerely,"), "de": ("gesendet von", "gesendet durch", "sent by", "sent via", "on behalf of", "mit freundlichen grüßen", "viele grüße")}, 64, "whitespace"),
)
_BOUNDARY = {"punctuation": re.compile(r"\s*(?:[.,:;)\]>]|$)|[^\S\n]*\n"), "whitespace": re.compile(r"[\s.,:;]|$"), "line_end": re.compile(r"[\r\n]|$")}


def scan_anchored(text: str, rules=ANCHORED, chain: tuple[str, ...] = ("en-US", "global")) -> list[Candidate]:
    """Persons' names beside the cue phrases of the chain's languages."""
    low, out, seen = text.lower(), [], set()
    if len(low) != len(text):
        return []
    languages = {c.split("-")[0] for c in chain}
    for rule in rules:
        for cue in dict.fromkeys(c for lang, cues in rule.cues.items() if lang in languages for c in cues):
            at = low.find(cue)
            while at >= 0:
                end = at + len(cue)
                if not tx.is_inside_word(text, at) and not tx.is_inside_word(text, end):
                    if rule.side == "before":
                        gap = re.match(r"[\s:,\"<-]*", text[end : end + rule.window]).end()
                        m = _PERSON.match(text, end + gap, end + rule.window)
                    else:
                        m = next((x for x in reversed(list(_PERSON.finditer(text, max(0, at - rule.window), at))) if not text[x.end() : at].strip(" ,:")), None)
                    if m:
                        span = tx.extend_over_name_joiners(text, *m.span())
                        if (rule.id, *span) not in seen and (rule.side == "after" or _BOUNDARY[rule.boundary].match(text, span[1])):
                            seen.add((rule.id, *span))
                            out.append(Candidate(*span, "name", rule.id, rule.base, rule.priority))
                at = low.find(cue, end)
    return out


_ADMITTED: dict = {}


def _admitted(rules, locale: str) -> tuple[Rule, ...]:
    """Rules that run under one locale of a chain, kept for the last packs used."""
    key = (id(rules), locale)
    if key not in _ADMITTED or _ADMITTED[key][0] is not rules:
        if len(_ADMITTED) > 256:
            _ADMITTED.clear()
        _ADMITTED[key] = (rules, admitted(rules, (locale,) if locale != "global" else ()))
    return _ADMITTED[key][1]


def detect(text: str, rules=CORE, chain: tuple[str, ...] = ("en-US", "global"), dictionaries: dict[str, tuple[str, list[str], bool]] | None = None, extra=()) -> Pool:
    """All candidates. Later locales of the chain yield to spans an earlier one has claimed, unless they contain them."""
    pool = Pool()
    low, digit = text.lower(), any(map(text.__contains__, "0123456789"))
    claimed: list[tuple[int, int]] = []
    seen: set[tuple[str, int, int]] = set()
    done: set[int] = set()
    for locale in chain:
        new = []
        for rule in _admitted(rules, locale):
            if id(rule) in done:  # an earlier locale has scanned it: every match is known
                continue
            done.add(id(rule))
            for c in scan_rule(rule, text, low, digit):
                if (c.rule, c.start, c.end) in seen:
                    continue
                seen.add((c.rule, c.start, c.end))
                local = "global" not in rule.locales and rule.basis == "document"
                if local and any(a < c.end and c.start < b and not (c.start <= a and b <= c.end and (c.start, c.end) != (a, b)) for a, b in claimed):
                    continue
                new.append((c, local))
        claimed += [(c.start, c.end) for c, local in new if local]
        for c, _ in new:
            (pool.vetoed if c.rejected or c.reason and c.evidence == "rule" else pool.live).append(c)
    for name, (cls, terms, case) in (dictionaries or {}).items():
        pool.live += scan_dictionary(name, terms, cls, text, case)
    pool.live += scan_anchored(text, chain=chain)
    for recognizer in extra:
        for c in recognizer(text, list(pool.live)):
            if not math.isfinite(c.score):
                raise ValueError(f"{c.rule}: a score must be finite")
            pool.live.append(c)
    pool.live = trim(text, pool.live)
    return pool


def trim(text: str, live: list[Candidate]) -> list[Candidate]:
    """A validated value of another class inside a completed or phone span cuts it there."""
    sure = [c for c in live if c.tier == VALIDATED]
    out = []
    for c in live:
        if c.scan == "completed" or c.cls == "custom:phone" and c.tier != VALIDATED:
            for v in sure:
                if v.cls != c.cls and c.start < v.start < c.end <= v.end:
                    end = v.start - (len(text[c.start : v.start]) - len(text[c.start : v.start].rstrip(" -/.,")))
                    c = replace(c, end=end) if end > c.start else c
        out.append(c)
    return out


# resolution ---------------------------------------------------------------------------------------------------


def overlaps(a, b) -> bool:
    return a.start < b.end and b.start < a.end


def contains(a, b) -> bool:
    return a.start <= b.start and b.end <= a.end and (a.start, a.end) != (b.start, b.end)


def _base(a: Candidate, b: Candidate) -> tuple[Candidate, str]:
    for tier, x, y in (("class_priority", class_rank(a.cls), class_rank(b.cls)), ("rule_priority", a.priority, b.priority), ("score", a.score, b.score), ("span_length", a.end - a.start, b.end - b.start)):
        if x != y:
            return (a if x > y else b), tier
    return (a if a.rule <= b.rule else b), "recognizer_id"


def decide(new: Candidate, old: Candidate, enclosing: bool) -> tuple[Candidate, str]:
    """Winner of two overlapping candidates and the rung that decided."""
    same, exact = new.cls == old.cls, (new.start, new.end) == (old.start, old.end)
    outer = new if contains(new, old) else old if contains(old, new) else None
    inner = old if outer is new else new
    kin = new.family and new.family == old.family and new.variant != old.variant
    if enclosing and same and outer:
        return outer, "same_class_containment"
    if kin and new.precedence == old.precedence:
        start, end = min(new.start, old.start), max(new.end, old.end)
        return replace(new, start=start, end=end, cls=f"custom:family:{new.family}", canonical=None, merged=tuple(sorted({new.rule, old.rule}))), "precedence_tie"
    if exact and same:
        lead, _ = _base(new, old)
        ids = tuple(sorted({*(new.merged or (new.rule,)), *(old.merged or (old.rule,))}))
        return replace(lead, score=min(1.0, 1 - (1 - new.score) * (1 - old.score)), canonical=new.canonical or old.canonical, merged=ids), "merged"
    if not enclosing and same and outer:
        if (new.tier == VALIDATED) != (old.tier == VALIDATED):
            return (new if new.tier == VALIDATED else old), "validator"
        return _base(new, old)
    if kin:
        return (new if new.precedence < old.precedence else old), "collision_policy"
    if new.anchors:
        return new, "anchored_context"
    if outer and not same and outer.tier >= inner.tier:
        return outer, "containment_precedence"
    if outer and not same and outer.cls.startswith("custom:") and not inner.cls.startswith("custom:"):
        return outer, "structured_containment"
    return _base(new, old)


def _fold(pool: list[Candidate], enclosing: bool) -> tuple[list[Candidate], list[tuple[Candidate, str]], bool]:
    """Candidates in total order take slots; of the rivals a newcomer overlaps, the one that came first meets it. Slots
    are disjoint and kept by place, so its rivals are neighbours."""
    starts: list[int] = []
    slots: list[tuple[int, Candidate]] = []  # (arrival, candidate), by start
    losers: list[tuple[Candidate, str]] = []
    used, arrivals = False, 0
    for c in sorted(pool, key=order_key):
        while True:
            low = bisect_right(starts, c.start)
            low -= bool(low) and slots[low - 1][1].end > c.start
            high = bisect_left(starts, c.end, low)
            if low >= high:
                starts.insert(low, c.start)
                slots.insert(low, (arrivals, c))
                arrivals += 1
                break
            at = min(range(low, high), key=lambda i: slots[i][0])
            arrival, old = slots[at]
            won, rung = decide(c, old, enclosing)
            used |= rung == "same_class_containment"
            if won is old:
                slots[at] = arrival, replace(old, decided_by=rung if old.decided_by == "none" else old.decided_by)
                losers.append((c, rung))
                break
            losers.append((old if won is c or rung != "merged" else c, rung))
            won = replace(won, decided_by=rung)
            if rung == "merged":  # the same span
                slots[at] = arrival, won
                break
            del starts[at], slots[at]
            low = bisect_right(starts, won.start)
            low -= bool(low) and slots[low - 1][1].end > won.start
            high = bisect_left(starts, won.end, low)
            losers += [(s, rung) for _, s in sorted(slots[low:high], key=lambda s: s[0])]
            del starts[low:high], slots[low:high]
            c = won
    return [s for _, s in slots], losers, used


def covers(a: list[Candidate], b: list[Candidate]) -> bool:
    """Every position of ``b``'s spans lies in one of ``a``'s (both disjoint and in order)."""
    for x in b:
        at = x.start
        for y in a:
            if y.start <= at < y.end:
                at = y.end
        if at < x.end:
            return False
    return True


def resolve(pool: list[Candidate], text: str = "", chain: tuple[str, ...] = ("global",)) -> tuple[list[Candidate], list[tuple[Candidate, str]]]:
    """Disjoint winners and (loser, rung): enclosing mode if it covers all that the prior mode covers."""
    kept, losers, used = _fold(pool, True)
    if used:
        prior = _fold(pool, False)
        if not covers(kept, prior[0]):
            kept, losers = prior[:2]
    out = []
    for c in kept:
        if c.anchors and c.decided_by != "collision_policy":
            around = text[max(0, c.start - CUE_WINDOW) : c.end + CUE_WINDOW].lower()
            if set(chain) <= {"global"} or not any(a in around for a in c.anchors):
                c = replace(c, cls=f"custom:family:{c.family}", decided_by="no_anchor")
        out.append(c)
    return out, losers


def plan(text: str, pool: Pool, chain: tuple[str, ...]) -> tuple[list[Candidate], list[Candidate], list[tuple[Candidate, str]]]:
    """(primary, recovered, losers): candidates wholly inside what no winner covers are resolved again, until none is left."""
    primary, losers = resolve(pool.live, text, chain)
    won = list(primary)
    recovered: list[Candidate] = []
    rest = [c for c, _ in losers]
    while rest := [c for c in rest if not any(overlaps(c, w) for w in won)]:
        more, lost = resolve(rest, text, chain)
        recovered += more
        won += more
        rest = [c for c, _ in lost]
    return primary, sorted(recovered, key=lambda c: c.start), losers


def residual_cells(won: list[Candidate], losers: list[tuple[Candidate, str]], protective) -> list[Candidate]:
    """What protective losers claim and no protective winner covers, cut at every border, by the best claimant."""
    claims = [c for c, _ in losers if protective(c.cls)]
    shut = [w for w in won if protective(w.cls)]
    points = sorted({p for c in (*claims, *shut) for p in (c.start, c.end)})
    cells: list[Candidate] = []
    for a, b in zip(points, points[1:], strict=False):
        over = [c for c in claims if c.start <= a and b <= c.end]
        if over and not any(w.start <= a and b <= w.end for w in shut):
            best = min(over, key=order_key)
            if cells and cells[-1].end == a and cells[-1].rule == best.rule and cells[-1].cls == best.cls:
                cells[-1] = replace(cells[-1], end=b)
            else:
                cells.append(replace(best, start=a, end=b, decided_by="residual"))
    return cells


# repeated values ----------------------------------------------------------------------------------------------

#: Least sizes of values and parts, parts of a name, and patterns beyond which a document is refused.
MIN_VALUE, MIN_DIGITS, MIN_PART, MAX_PARTS, MAX_PATTERNS = 4, 6, 3, 6, 200_000
COMMON = {"and", "the", "for", "von", "van", "der", "den", "del", "team", "support", "office", "gmbh", "group", "mail", "info", "sales", "will", "may", "mark"}


def sweep_patterns(values: list[tuple[str, str]]) -> dict[str, str]:
    """Pattern to class: whole values, and the distinctive parts of names."""
    out: dict[str, str] = {}
    for cls, value in values:
        if len(value) >= MIN_VALUE and not (value.isdigit() and len(value) < MIN_DIGITS):
            out.setdefault(value, cls)
        parts = value.split()
        if cls == "name" and 1 < len(parts) <= MAX_PARTS:
            for p in parts:
                if len(p) >= MIN_PART and p.lower() not in COMMON and p[0].isupper():
                    for spelling in tx.word_spellings(p):
                        out.setdefault(spelling, cls)
    if len(out) > MAX_PATTERNS:
        raise ValueError("too many repeat patterns: refusing rather than skipping some")
    return out


def sweep(text: str, won: list[Candidate], session: list[tuple[str, str]] = ()) -> list[Candidate]:
    """Copies of rule-found values, and of the session's, outside what is covered; none inside a word or URL."""
    sources = [(c.cls, text[c.start : c.end]) for c in won if c.tier >= PATTERN and not c.cls.startswith("custom:family:")] + list(session)
    patterns = sweep_patterns(sources)
    if not patterns:
        return []
    urls = [m.span() for m in re.finditer(r"(?:https?://|www\.)\S+", text)]
    out: list[Candidate] = []
    hits = scan_dictionary("sweep", sorted(patterns), "", text, whole=False)
    for c in sorted(hits, key=lambda h: (h.start, -h.end)):
        if tx.is_inside_word(text, c.start) or tx.is_inside_word(text, c.end) or any(a <= c.start < b for a, b in urls):
            continue
        if not any(overlaps(c, o) for o in (*won, *out)):
            out.append(replace(c, cls=patterns[text[c.start : c.end]], rule="sweep", priority=60, canonical=None, decided_by="sweep"))
    return out


# second passes ------------------------------------------------------------------------------------------------

STREETS = {"de": (("straße", "strasse", "weg", "platz", "allee", "gasse"), "after"), "en": (("street", "road", "avenue", "lane", "drive"), "before"), "fr": (("rue", "avenue", "boulevard"), "before")}
_NUMBER = r"[0-9]{1,4} ?[a-zA-Z]?"


def house_numbers(text: str, won: list[Candidate], lang: str) -> list[Candidate]:
    """Numbers beside a street (a location whose text names one); which side depends on the language; no bare years."""
    words, side = STREETS.get(lang, ((), "after"))
    out = []
    for c in won:
        if c.cls != "location" or not any(w in text[c.start : c.end].lower() for w in words):
            continue
        m = re.match(rf"[ ,]+({_NUMBER})\b", text[c.end : c.end + 12]) if side == "after" else re.search(rf"\b({_NUMBER})[ ,]+$", text[max(0, c.start - 12) : c.start])
        if m and not re.fullmatch("(?:19|20)[0-9]{2}", m[1].strip()):
            base = c.end if side == "after" else max(0, c.start - 12)
            out.append(Candidate(base + m.start(1), base + m.start(1) + len(m[1].rstrip()), "location", "house_number", 0.8, 75))
    return out


_UNIT = re.compile(r"(?i)[ ,]+((?:apt|apartment|unit|suite|floor|room|box|psc|wohnung|etage)\.? ?#?[A-Za-z0-9-]{1,6}|[A-Z]{2} [0-9]{5})")


def grow_addresses(text: str, won: list[Candidate]) -> list[Candidate]:
    """Location spans grown over at most five unit, region or postal pieces to the right."""
    taken, out = [c.start for c in won], []
    for c in won:
        end = c.end
        if c.cls == "location":
            for _ in range(5):
                m = _UNIT.match(text, end)
                if not m or any(end <= s < m.end() for s in taken):
                    break
                end = m.end()
        out.append(c if end == c.end else replace(c, end=end, decided_by="address_growth"))
    return out


# a document ---------------------------------------------------------------------------------------------------


def protect(text: str, chain=("en-US", "global"), rules=CORE, dictionaries=None, extra=(), session=(), protective=lambda cls: True):
    """(primary, recovered, residual, losers, vetoed) of a raw text, offsets in UTF-8 bytes of it."""
    view, spans = tx.normalize(text)
    pool = detect(view, rules, chain, dictionaries, extra)
    primary, recovered, losers = plan(view, pool, chain)
    if more := sweep(view, [c for c in (*primary, *recovered) if protective(c.cls)], list(session)):
        pool.live += more
        primary, recovered, losers = plan(view, pool, chain)
    lang = chain[0].split("-")[0]
    if more := house_numbers(view, primary, lang):
        pool.live += more
        primary, recovered, losers = plan(view, pool, chain)
    primary = grow_addresses(view, primary)
    cells = residual_cells([*primary, *recovered], losers, protective)

    ascii_ = view.isascii()
    every = (*primary, *recovered, *cells, *(c for c, _ in losers), *pool.vetoed)
    offset = None if ascii_ else _byte_offsets(view, {p for c in every for p in (c.start, c.end)})

    def raw(c: Candidate) -> Candidate:
        a, b = (c.start, c.end) if ascii_ else (offset[c.start], offset[c.end])
        a, b = tx.raw_range(spans, a, b) or (a, b)
        return replace(c, start=a, end=b)

    return [raw(c) for c in primary], [raw(c) for c in recovered], [raw(c) for c in cells], [(raw(c), r) for c, r in losers], [raw(c) for c in pool.vetoed]


def _byte_offsets(text: str, points: set[int]) -> dict[int, int]:
    """UTF-8 bytes before each of some positions."""
    out, at, last = {}, 0, 0
    for p in sorted(points):
        at += len(text[last:p].encode())
        out[p] = at
        last = p
    return out
