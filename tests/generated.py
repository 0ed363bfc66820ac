"""Statements made from a small grammar of captions, dates and lists, with the fields that must come of them.

Each maker draws numbers and words and says both what the statement looks like and what its fields hold; nothing here
reads a statement.
"""

import random

# Fixed values of the holdings format: subfields of three levels, year, month and day; codes of months and seasons.
ENUM, YEAR, MONTH, DAY = "abc", "i", "j", "k"
MONTHS = {"Jan": "01", "Feb.": "02", "March": "03", "Apr": "04", "May": "05", "June": "06", "Jul.": "07", "August": "08", "Sept.": "09", "Oct": "10", "November": "11", "Dec.": "12"}
SEASONS = {"Spring": "21", "Summer": "22", "Autumn": "23", "Fall": "23", "Winter": "24"}
CAPTIONS = {"v.": ("v.", "v. ", "Vol. ", "volume "), "no.": ("no.", "no. ", "No. ", "issue "), "pt.": ("pt.", "pt. ", "Part ")}
NAMES = tuple(CAPTIONS)


def field(values, closed=None, mark=None):
    """A holdings field as it is shown, without its number; values: (code, value) in order."""
    dashed = any("-" in v for _, v in values)
    return f"4{'0' if dashed else '1'} " + " ".join(f"${c} {v}" for c, v in sorted(values)) + (f" $w {mark}" if mark else "")


def paired(starts, ends):
    """Both ends of levels, the most significant first: equal ones are written once, unless something above them runs."""
    out, runs = [], False
    for s, e in zip(starts, ends, strict=True):
        out.append(s if s == e and not runs else f"{s}-{e}")
        runs |= s != e
    return out


class Maker:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def depth(self):
        return self.rng.randint(1, 3)

    def numbers(self, depth, low=1):
        return [str(self.rng.randint(low, 99)) for _ in range(depth)]

    def written(self, numbers, first=0):
        """Levels with their captions, in one of the usual notations."""
        parts = [self.rng.choice(CAPTIONS[NAMES[first + i]]) + n for i, n in enumerate(numbers)]
        return self.rng.choice((":", " ", ", ")).join(parts)

    def date(self, kind):
        """(text inside parentheses, values) of a year, a month, a season or a day."""
        y = str(self.rng.randint(1900, 1989))
        if kind == "year":
            return y, [(YEAR, y)]
        word, code = self.rng.choice(list((SEASONS if kind == "season" else MONTHS).items()))
        if kind == "day":
            d = str(self.rng.randint(1, 28))
            return f"{word} {d}, {y}", [(YEAR, y), (MONTH, code), (DAY, d)]
        return self.rng.choice((f"{word} {y}", f"{y}:{word}")), [(YEAR, y), (MONTH, code)]

    def kind(self):
        return self.rng.choice(("year", "month", "season", "day"))

    # ---- statements: text, fields, caption field, flagged

    def caption(self, depth, kind):
        words = {"year": [], "month": ["$j (month)"], "season": ["$j (season)"], "day": ["$j (month)", "$k (day)"]}[kind] if kind else []
        return " ".join(["853 31 $8 1", *(f"${ENUM[i]} {NAMES[i]}" for i in range(depth)), *(["$i (year)"] if kind else []), *words])

    def unit(self):
        depth, kind = self.depth(), self.kind()
        n, (when, values) = self.numbers(depth), self.date(kind)
        return f"{self.written(n)}{self.rng.choice(('', ' '))}({when})", [field([*zip(ENUM, n, strict=False), *values])], self.caption(depth, kind), False

    def undated(self):
        depth = self.depth()
        n = self.numbers(depth)
        return self.written(n), [field(list(zip(ENUM, n, strict=False)))], self.caption(depth, None), False

    def open(self):
        depth = self.depth()
        n, (when, values) = self.numbers(depth), self.date("year")
        return f"{self.written(n)}({when})-", [field([(c, f"{v}-") for c, v in [*zip(ENUM, n, strict=False), *values]])], self.caption(depth, "year"), False

    def run(self):
        """From one unit to a later one, both written out."""
        depth, kind = self.depth(), self.rng.choice(("year", "month"))
        a, b = self.numbers(depth), self.numbers(depth)
        a[0], b[0] = str(self.rng.randint(1, 40)), str(self.rng.randint(41, 80))
        years = [str(self.rng.randint(1900, 1940)), str(self.rng.randint(1941, 1980))]
        months = [self.rng.choice(list(MONTHS.items())) for _ in range(2)]
        text = [f"{self.written(n)}({m[0]} {y})" if kind == "month" else f"{self.written(n)}({y})" for n, m, y in zip((a, b), months, years, strict=True)]
        dates = paired(*([y, m[1]][: 1 + (kind == "month")] for y, m in zip(years, months, strict=True)))
        return "-".join(text), [field([*zip(ENUM, paired(a, b), strict=False), *zip((YEAR, MONTH), dates, strict=False)])], self.caption(depth, kind), False

    def span(self):
        """A run of one level and of years in one unit."""
        s, y = self.rng.randint(1, 50), self.rng.randint(1900, 1950)
        n = self.rng.randint(1, 20)
        return f"{self.rng.choice(CAPTIONS['v.'])}{s}-{s + n} ({y}-{y + n})", [field([("a", f"{s}-{s + n}"), (YEAR, f"{y}-{y + n}")])], self.caption(1, "year"), False

    def listed(self):
        """Numbers under one volume, with months of one year; a break where one is left out."""
        at = sorted(self.rng.sample(range(1, 13), self.rng.randint(2, 6)))
        v, y, words = self.rng.randint(1, 90), str(self.rng.randint(1900, 1980)), list(MONTHS.items())
        text = f"v. {v} nos. {', '.join(map(str, at))} ({', '.join(words[i - 1][0] for i in at)} {y})"
        marks = ["g" if b - a > 1 else None for a, b in zip(at, at[1:], strict=False)] + [None]
        return text, [field([("a", str(v)), ("b", str(i)), (YEAR, y), (MONTH, words[i - 1][1])], mark=m) for i, m in zip(at, marks, strict=True)], self.caption(2, "month"), False

    def runs(self):
        """Two runs of volumes with a gap between them."""
        s, y = self.rng.randint(1, 30), self.rng.randint(1900, 1940)
        first, second = f"{s}-{s + 2}", f"{s + 5}-{s + 9}"
        years = f"{y}-{y + 2}", f"{y + 5}-{y + 9}"
        text = f"v. {first} ({years[0]}), v. {second} ({years[1]})"
        return text, [field([("a", first), (YEAR, years[0])], mark="g"), field([("a", second), (YEAR, years[1])])], self.caption(1, "year"), False

    def dates(self):
        """Dates alone: a year, or a run of years."""
        y = self.rng.randint(1900, 1950)
        n = self.rng.randint(0, 9)
        value = f"{y}-{y + n}" if n else str(y)
        return value, [field([(YEAR, value)])], "853 31 $8 1 $i (year)", False

    def block(self):
        """year: volume (number [month])."""
        y, v, n = str(self.rng.randint(1900, 1980)), str(self.rng.randint(1, 90)), str(self.rng.randint(1, 12))
        word, code = self.rng.choice([(w, c) for w, c in MONTHS.items() if not w.endswith(".")])
        return f"{y}: {v} ({n} [{word}])", [field([("a", v), ("b", n), (YEAR, y), (MONTH, code)])], "853 31 $8 1 $a (*) $b (*) $i (year) $j (month)", False

    def bare(self):
        """A volume without a caption above a captioned number."""
        v, n, y = *self.numbers(2), str(self.rng.randint(1900, 1980))
        return f"{v} no. {n} ({y})", [field([("a", v), ("b", n), (YEAR, y)])], "853 31 $8 1 $a (*) $b no. $i (year)", False

    def combined(self):
        """Double numbers and months."""
        n, y, i = self.rng.randint(1, 90), str(self.rng.randint(1900, 1980)), self.rng.randint(0, 10)
        words = list(MONTHS.items())
        return f"no. {n}/{n + 1} ({words[i][0]}/{words[i + 1][0]} {y})", [field([("a", f"{n}/{n + 1}"), (YEAR, y), (MONTH, f"{words[i][1]}/{words[i + 1][1]}")])], "853 31 $8 1 $a no. $i (year) $j (month)", False

    def in_part(self):
        """A unit that can be read, and words that can't."""
        text, fields_, caption, _ = self.span()
        words = self.rng.choice(("lacks 3", "see the copy on shelf 4", "n.s.", "bound with another"))
        return f"{text}, {words}", [f"{fields_[0]} $w g"], caption, True


SHAPES = ("unit", "undated", "open", "run", "span", "listed", "runs", "dates", "block", "bare", "combined", "in_part")
WRITTEN = [getattr(Maker(f"{shape}{i}"), shape)() for shape in SHAPES for i in range(25)]

_rng = random.Random(7)
_n = lambda low=1, high=99: str(_rng.randint(low, high))
NOTHING = ["", *(t for _ in range(6) for t in (f"? {_n()}", f"?: {_n()}", _n(1, 999), f"the {_n()} copies are lost", f"v.{_n()}(1990)-v.{_n()}(1994-)", f"Heft {_n()}", f"v. {_n(1, 9)}-{_n(10, 20)} (1990)-"))]
ELSEWHERE = [x for _ in range(6) for x in ((f"v. {_n()} Suppl. (1990)", "867"), (f"v. {_n()} supplement", "867"), (f"special issue {_n()}", "867"), (f"Index to v. {_n()}-{_n()}", "868"), (f"v.{_n()} indexes (1980)", "868"), (f"v.{_n()} {{Index in v.{_n()}}}", None), (f"supplied v. {_n()}", None))]
