"""Clusters of statements by shape, and a library of confirmed patterns that read them.

Clusters: texts are counted before they are signed, each task sums up what its texts of a signature add to the pattern
(captions seen, the longest free text), and only these sums meet; so a signature that holds a third of all texts is
never in one task. Matches are counted natively, by the expression in the Java dialect.

Libraries: at most 200 patterns, so one travels with the code that applies it. The first pattern by priority that
applies to a statement wins; the grammar reads the statement all the same, and the pattern gives what the grammar
can't know: captions, or the reading of a statement that the grammar refuses.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriate.functions import budget, dialects, fields, grammar, shape
from seriate.functions.chronology import code_of, full_year
from seriate.functions.schemas import PARSED
from seriate.operators.code import arrow_map, spread
from seriate.operators.reading import arrow_schema, table_of, to_row

MOST_PATTERNS, MOST_CHARS, MOST_EXAMPLES, MOST_PROBES = 200, 4000, 25, 200
KINDS = ("enum", "year", "month", "day", "ignore", "unresolved")
SUGGESTED = {"vol": "v.", "iss": "no.", "part": "pt."}


# ---- signatures -----------------------------------------------------------------------------------------


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shape.signature(t) for t in b["text"].to_pylist()], pa.string())], [*b.schema.names, "signature"])


def signed(texts: DataFrame) -> DataFrame:
    """texts (text, and what else they have) with their signatures."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields) + ", signature string"
    return arrow_map(texts, _signed, ddl)


def parted(texts: DataFrame) -> DataFrame:
    """texts (text, and what else they have) with the parts of each that patterns see."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields) + ", parts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(pieces(t.strip())) for t in b["text"].to_pylist()], pa.list_(pa.string()))], [*b.schema.names, "parts"])

    return arrow_map(texts, run, ddl)


# ---- clusters -------------------------------------------------------------------------------------------


#: Signatures that a task sums up before it sends them.
HELD_SIGNATURES = 50_000
_CLUSTER = "signature string, state string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the texts of each signature add to its pattern; also sums of such sums (column state)."""
    held: dict[str, shape.State] = {}
    for b in batches:
        for r in b.to_pylist():
            more = shape.State.of(r["text"], r["pos"]) if "text" in r else shape.State.loads(r["state"])
            own = held.get(r["signature"])
            held[r["signature"]] = more if own is None else own.plus(more)
        if len(held) > HELD_SIGNATURES:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.dumps() for x in held.values()])], ["signature", "state"])
            held = {}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.dumps() for x in held.values()], pa.string())], ["signature", "state"])


_MADE = "signature string, label string, regex string, java string, groups array<string>, declined string, variants string"


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, expression and caption variants of each signature; all its sums are in one task, one for each task before."""
    for b in _summed(batches):
        rows = []
        for signature, state in zip(b["signature"].to_pylist(), b["state"].to_pylist(), strict=True):
            state = shape.State.loads(state)
            made = state.pattern()
            java = dialects.convert(made["regex"], "java") if made["regex"] else None
            rows.append([signature, shape.label(state.text), made["regex"], java and java.text, made["groups"], made["declined"], json.dumps(state.variants())])
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _MADE.split(", ")])


def clusters(statements: DataFrame) -> DataFrame:
    """Clusters of statements (text, pos) by signature, the largest first.

    signature, label, count, first_pos, examples (the first by place), regex, groups, matched, match_rate, declined,
    variants (JSON: spellings of captions by kind).
    """
    texts = statements.select(F.trim("text").alias("text"), "pos").where("text <> ''").groupBy("text").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    # dealt by text, so no signature is in one task; the three readers below share this shuffle
    each = signed(spread(texts, "text")).repartition("text")
    sums = arrow_map(each.select("signature", "text", "pos"), _summed, _CLUSTER)
    made = arrow_map(sums.repartition("signature"), _made, _MADE)
    counted = each.join(made.select("signature", "java"), "signature")
    hit = F.rlike("text", "java")  # of the whole text, whatever its case
    sizes = counted.groupBy("signature").agg(F.sum("n").alias("count"), F.min("pos").alias("first_pos"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("matched"))
    nth = F.row_number().over(Window.partitionBy("signature").orderBy("pos", "text"))
    few = each.withColumn("nth", nth).where(F.col("nth") <= MOST_EXAMPLES).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("few"))
    out = sizes.join(made.drop("java"), "signature").join(few, "signature")
    rate = F.round(F.coalesce(F.col("matched") / F.nullif("count", F.lit(0)), F.lit(1.0)), 4)
    return out.select("signature", "label", "count", "first_pos", F.col("few.text").alias("examples"), "regex", "groups", "matched", rate.alias("match_rate"), "declined", "variants").orderBy(F.desc("count"), "first_pos")


def cluster_json(found: DataFrame) -> DataFrame:
    """Each cluster as one JSON document."""
    return found.select(F.to_json(F.struct("signature", "label", "count", "examples", "regex", F.col("groups").alias("named_groups"), "match_rate", "declined", F.col("declined").isNotNull().alias("too_complex"))).alias("json"))


# ---- roles and the library ------------------------------------------------------------------------------


@dataclass
class Role:
    group: str
    boundary: str
    kind: str
    level: int | None = None
    caption: str | None = None
    suggested: bool = False


@dataclass
class Pattern:
    id: str
    label: str
    regex: str
    roles: list[Role] = field(default_factory=list)
    split: bool = False
    priority: int = 0
    notes: str = ""
    skip: bool = False


def infer_roles(groups: list[str]) -> list[Role]:
    """What each group holds, by its name; bare numbers wait for a decision."""
    out = []
    for g in groups:
        edge, _, rest = g.partition("_")
        slot, _, again = rest.partition("_")
        if again:
            out.append(Role(g, edge, "ignore"))
        elif slot in ("year", "month", "day"):
            out.append(Role(g, edge, slot))
        elif slot in SUGGESTED:
            out.append(Role(g, edge, "enum", caption=SUGGESTED[slot]))
        else:
            out.append(Role(g, edge, "unresolved"))
    for a, b in zip(out, out[1:], strict=False):
        if a.kind == "unresolved" and b.caption == "no." and a.boundary == b.boundary:
            a.kind, a.caption, a.suggested = "enum", "v.", True
    return levelled(out)


def levelled(roles: list[Role]) -> list[Role]:
    """Levels for enumeration roles that have none: of each boundary, the first that is free."""
    for edge in ("start", "end"):
        own = [r for r in roles if r.boundary == edge and r.kind == "enum"]
        free = (i for i in range(len(own)) if i not in {r.level for r in own})
        for r in own:
            if r.level is None:
                r.level = next(free)
    return roles


def role_of(raw: dict) -> Role:
    """A role of a document; older ones give a level by its word (vol, iss, part) or by the name of a date."""
    known = {k: raw[k] for k in ("group", "boundary", "kind", "level", "caption", "suggested") if k in raw}
    word = known.get("level")
    if isinstance(word, str):
        known["level"] = None
        if word in SUGGESTED:
            known |= {"kind": "enum", "caption": known.get("caption") or SUGGESTED[word], "level": list(SUGGESTED).index(word)}
        elif word in KINDS:
            known["kind"] = word
        else:
            known["kind"] = "unresolved"
    edge = known["group"].partition("_")[0]
    return Role(**{"boundary": edge if edge in ("start", "end") else "start", "kind": "unresolved"} | known)


def roles_of(found: DataFrame) -> DataFrame:
    """signature, label, and a row for each group of a cluster's expression with the role that it is offered."""
    ddl = "signature string, label string, group string, boundary string, kind string, level int, caption string, suggested boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, n, r.group, r.boundary, r.kind, r.level, r.caption, r.suggested) for s, n, groups in zip(*(b[c].to_pylist() for c in ("signature", "label", "groups")), strict=True) for r in infer_roles(groups or [])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in ddl.split(", ")])

    return arrow_map(found.select("signature", "label", "groups"), run, ddl)


def merged_roles(old: list[Role], groups: list[str]) -> list[Role]:
    """Decisions on groups that are still there, and inferred roles for the rest."""
    known = {r.group: r for r in old}
    return [known.get(r.group, r) for r in infer_roles(groups)]


def faults(p: Pattern) -> list[str]:
    """Why a pattern can't enter the library."""
    if len(p.regex) > MOST_CHARS:
        return ["the expression is too long"]
    try:
        groups = set(re.compile(p.regex, re.I).groupindex)
    except re.error as e:
        return [f"the expression doesn't compile: {e}"]
    if p.skip:
        return []
    out = [] if groups else ["no named group"]
    named = [r.group for r in p.roles]
    out += [f"{g} has no role" for g in sorted(groups - set(named))] + [f"{g} isn't in the expression" for g in sorted(set(named) - groups)] + [f"{g} has two roles" for g in sorted({g for g in named if named.count(g) > 1})]
    places = [(r.boundary, r.kind, r.level if r.kind == "enum" else None) for r in p.roles if r.kind not in ("ignore", "unresolved")]
    out += [f"two groups are {b} {k}" for b, k, _ in sorted({x for x in places if places.count(x) > 1}, key=str)]
    out += [f"{r.group} has an unknown kind" for r in p.roles if r.kind not in KINDS]
    if p.roles and all(r.kind == "ignore" for r in p.roles):
        out.append("every group is ignored")
    return out


def load(document, known: frozenset[str] = frozenset(), probe: bool = True, statements: list[str] = ()) -> tuple[list[Pattern], list[str]]:
    """Patterns of a library document (or bare list, or their JSON), by priority; what doesn't hold is said.

    Expressions that aren't known are tried in a process of their own, on fixed texts and some statements, before they
    may enter: on executors nothing could end one that runs away.
    """
    if isinstance(document, (str, bytes)):
        try:
            document = json.loads(document)
        except ValueError as e:
            return [], [f"this isn't JSON: {e}"]
    if isinstance(document, dict):
        if document.get("schema") != 1:
            return [], [f"schema {document.get('schema')} isn't known"]
        document = document.get("patterns", [])
    if not isinstance(document, list):
        return [], ["a library is a list of patterns"]
    out, errors, seen = [], [], {}
    for raw in document[:MOST_PATTERNS]:
        try:
            p = Pattern(**{**raw, "roles": levelled([role_of(r) for r in raw.get("roles", [])])})
        except (TypeError, KeyError, AttributeError) as e:
            errors.append(f"a pattern can't be read: {e}")
            continue
        if seen.get(p.id) == raw:
            errors.append(f"{p.id} comes twice")
        elif bad := faults(p):
            errors += [f"{p.id}: {b}" for b in bad]
        else:
            while p.id in seen:  # another pattern of this id
                p.id = uuid.uuid4().hex[:12]
            seen[p.id] = raw
            out.append(p)
    if len(document) > MOST_PATTERNS:
        errors.append(f"only the first {MOST_PATTERNS} patterns were read; {len(document) - MOST_PATTERNS} more were ignored")
    fresh = [p.regex for p in out if p.regex not in known]
    slow = set(budget.runaways(fresh, list(statements)[:MOST_PROBES])) if probe and fresh else set()
    errors += [f"{p.label or p.id}: the expression doesn't end in time" for p in out if p.regex in slow]
    return sorted((p for p in out if p.regex not in slow), key=lambda p: -p.priority), errors


def merged_library(old: list[Pattern], new: list[Pattern], replace: bool = False) -> list[Pattern]:
    """A library with another taken in: whole, or pattern by pattern (one of the same id takes the old one's place)."""
    kept = [] if replace else [p for p in old if p.id not in {q.id for q in new}]
    return sorted([*kept, *new][:MOST_PATTERNS], key=lambda p: -p.priority)


def pattern_id(signature: str) -> str:
    """The same name for a signature wherever it is found."""
    return "p" + hashlib.sha256(signature.encode()).hexdigest()[:10]


def export(patterns: list[Pattern]) -> dict:
    return {"schema": 1, "tool": "seriate", "patterns": [asdict(p) for p in patterns]}


# ---- application ----------------------------------------------------------------------------------------


_WORD_BEFORE = re.compile(r"([A-Za-z][A-Za-z.'’]*)(-?)\s*$")


def _qualifier(m: re.Match, group: str) -> str:
    """The word right before a date that it may qualify (Late Summer); a month and a hyphen are a run of their own."""
    found = _WORD_BEFORE.search(m.string[: m.start(group)])
    return "" if not found or (found[2] and code_of(found[1])) else f"{found[1]}{found[2]} "


def _from_captures(p: Pattern, m: re.Match) -> tuple[dict | None, list[dict], list[str], list[str]]:
    """A range built from what the groups caught; what is said, what waits for a decision, what is set aside."""
    sides, notes, waits, aside = {"start": grammar.boundary(), "end": grammar.boundary()}, [], [], []
    levels: dict[str, dict[int, tuple]] = {"start": {}, "end": {}}
    for r in p.roles:
        value = (m[r.group] or "").strip()
        if not value:
            continue
        if r.kind in ("ignore", "unresolved"):
            notes.append({"kind": "note", "text": f"{value} is matched by the pattern, but not encoded"})
            (waits if r.kind == "unresolved" else aside).append(value)
        elif r.kind == "enum":
            levels[r.boundary][len(levels[r.boundary]) if r.level is None else r.level] = (r.caption, value)
        elif r.kind == "year":
            sides[r.boundary]["year"] = full_year(value)
        elif word := _qualifier(m, r.group):
            sides[r.boundary][r.kind] = word + value  # can't be coded, so the converter names it
        else:
            sides[r.boundary][r.kind] = "/".join(code_of(x) or x for x in value.split("/")) if r.kind == "month" else value
    for edge, found in levels.items():
        sides[edge]["enum"] = [found.get(i, (None, None)) for i in range(max(found) + 1)] if found else []
    some = {e: bool(b["enum"] or any(b[k] for k in ("year", "month", "day"))) for e, b in sides.items()}
    if not any(some.values()):
        return None, notes, waits, aside
    raw = m[0]
    return {"start": sides["start"], "end": sides["end"] if some["end"] else None, "open": not some["end"] and raw.rstrip(" )").endswith("-"), "raw": raw, "break_after": ""}, notes, waits, aside


def captioned(parsed: dict, captions: dict[tuple[str, int], str]) -> bool:
    """Puts confirmed captions, by boundary and level, on the levels that state none; whether there were any."""
    filled = False
    for r in parsed["ranges"]:
        for edge in ("start", "end"):
            if r[edge]:
                for i, (c, v) in enumerate(r[edge]["enum"]):
                    if not c and v and (edge, i) in captions:
                        r[edge]["enum"][i] = (captions[edge, i], v)
                        filled = True
    return filled


def _captions(p: Pattern) -> dict[tuple[str, int], str]:
    return {(r.boundary, r.level): r.caption for r in reversed(p.roles) if r.kind == "enum" and r.caption and r.level is not None}


@lru_cache(maxsize=4096)
def several_runs(text: str) -> bool:
    """More runs than a pattern can describe: its roles don't say which run a value opens."""
    return grammar.distributed(text) is not None or len(grammar.read(text)["ranges"]) > 1


@lru_cache(maxsize=4096)
def pieces(text: str) -> tuple[str, ...]:
    """The parts of a statement that patterns see: a list of runs stays whole."""
    return (text,) if grammar.distributed(text) is not None else tuple(shape.split_runs(text))


def _hits(p: Pattern, text: str, lists: bool) -> list[tuple[str, re.Match | None]]:
    rx = re.compile(p.regex, re.I)
    return [(s, None if several_runs(s) and not lists else rx.fullmatch(s)) for s in (pieces(text) if p.split else (text,))]


def _built(p: Pattern, text: str, hits: list[tuple[str, re.Match | None]]) -> dict | None:
    """The reading of a statement that the grammar refuses, from what the pattern caught."""
    out = {"raw": text, "success": True, "needs_review": False, "belongs_in": None, "skipped": [], "warnings": [], "attention": [], "ranges": []}
    say = lambda x: out["warnings"].append({"kind": "note", "text": x})
    waits, unread, lost = [], [], []
    for part, m in hits:
        if m is None:
            read = grammar.read(part)
            out["ranges"] += read["ranges"]
            out["warnings"] += read["warnings"] if read["ranges"] else []
            say(f"{part} doesn't match the pattern" + (" and was read without it" if read["ranges"] else ", and can't be read without it"))
            unread += [] if read["ranges"] else [part]
            continue
        r, notes, waiting, aside = _from_captures(p, m)
        out["warnings"] += notes
        waits += waiting
        if _written_as_list(part):
            lost += aside
        if r is None:
            say(f"{part}: the pattern catches nothing to encode")
            continue
        out["ranges"].append(r)
        for kind, raw in shape.tokens(part):
            if kind == "UNKNOWN" and re.search(r"[^\s.,;:]", raw):
                note = f"{raw.strip()} in {part} isn't recorded in any field"
                if note not in out["attention"]:
                    say(note)
                    out["attention"].append(note)
    if not out["ranges"]:
        return None
    for found, why in ((unread, "only part of the statement could be read, not: "), (lost, "the statement lists several runs, of which the pattern would set aside: ")):
        if found:
            note = why + ", ".join(found)
            out["warnings"].insert(0, {"kind": "note", "text": note})
            out["attention"].append(note)
    out["needs_review"] = bool(waits or unread or lost)
    return out


def _written_as_list(text: str) -> bool:
    """Commas before the dates, with bare numbers behind them."""
    head = re.sub(r"\([^()]*\)\s*-?\s*$", "", text)
    return any(x[:1].isdigit() for x in grammar.split_top(head, ",")[1:])


def read_by(text: str, patterns: list[Pattern], fallback: str = "parser") -> tuple[str, dict]:
    """Source (pattern id, skipped, parser or unmatched) and reading.

    fallback: parser (what no pattern matches is read by the grammar), strict (but held unless read without a word to
    say), or off (left as it is; then all parts of a statement must match).
    """
    body, passed_over = (text or "").strip(), None
    for p in patterns if body else ():
        if p.skip:
            if all(m for _, m in _hits(p, body, lists=True)):
                return "skipped", _untouched(text, f"skipped by the pattern {p.label or p.id}")
            continue
        if passed_over is None and several_runs(body) and re.compile(p.regex, re.I).fullmatch(body):
            passed_over = p
        hits = _hits(p, body, lists=False)
        if not any(m for _, m in hits) or (fallback == "off" and not all(m for _, m in hits)):
            continue
        parsed = grammar.read(text)
        if parsed["ranges"]:
            captioned(parsed, _captions(p))
            return p.id, parsed
        if parsed["belongs_in"]:
            return p.id, parsed
        if (made := _built(p, text, hits)) is not None:
            return p.id, made
    if fallback == "off":
        return "unmatched", _untouched(text, "no pattern matches")
    parsed = grammar.read(text)
    if fallback == "strict" and parsed["ranges"] and (said := fields.convert(grammar.read(text))["warnings"]):
        return "parser", parsed | {"success": False, "needs_review": True, "ranges": [], "warnings": [{"kind": "note", "text": "held, as not all of it could be accounted for"}, *said]}
    if passed_over is not None:
        own = {(e, lvl): c for (b, lvl), c in _captions(passed_over).items() if b == "start" for e in ("start", "end")}
        used = captioned(parsed, own)
        parsed["warnings"].append({"kind": "note", "text": f"{passed_over.label or passed_over.id} matches, but describes one run of several" + ("; its captions are used" if used else "")})
    return "parser", parsed


def _untouched(text: str, why: str) -> dict:
    return {"raw": text, "success": False, "needs_review": False, "belongs_in": None, "skipped": [], "warnings": [{"kind": "note", "text": why}], "attention": [], "ranges": []}


def apply(statements: DataFrame, patterns: list[Pattern], fallback: str = "parser") -> DataFrame:
    """source and parsed of every statement; each distinct text is matched once."""
    ddl = f"text string, source string, parsed {PARSED}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, *read_by(t, patterns, fallback)) for t in b["text"].to_pylist()]
            yield from table_of([{"text": t, "source": s, "parsed": to_row(p)} for t, s, p in found], schema).to_batches()

    texts = statements.where("text IS NOT NULL").select("text").distinct()
    return statements.join(arrow_map(spread(texts, "text"), run, ddl), "text", "left")
