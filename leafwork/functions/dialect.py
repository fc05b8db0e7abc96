"""SQL text for two engines from one specification: Spark runs it, DuckDB checks it.

Only regular expressions that Java and RE2 read alike are used: no lookaround, no back-references, no \\b, explicit
classes for words and spaces. Conventions of the engines (literals, group references, flags, lambdas) differ here only.
"""

from __future__ import annotations

#: White space as Python's str methods see it in extracted text: ASCII white space, no-break space, other blanks.
S = r"[\s\x{000B}\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"
#: The inside of that class, to build others.
S_IN = S[1:-1]
#: The same characters one by one.
BLANKS = " \t\n\v\f\r\x85\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u3000"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


class Dialect:
    """Builders of SQL expressions; arguments are SQL text unless named pattern, text or names."""

    def __init__(self, name: str):
        self.name, self.spark = name, name == "spark"

    def lit(self, text: str) -> str:
        if not self.spark:
            return "'" + text.replace("'", "''") + "'"
        if "\n" in text or ("'" in text and '"' in text):
            return "concat(" + ", ".join(f"char({ord(c)})" if c in "\n'\"" else f"r'{c}'" for c in text) + ")"
        return f'r"{text}"' if "'" in text else f"r'{text}'"

    def _p(self, pattern: str, fold: bool) -> str:
        flags = ("(?iu)" if self.spark else "(?i)") if fold else ""
        return self.lit(flags + pattern)

    def has(self, x: str, pattern: str, fold: bool = False) -> str:
        return f"({x} RLIKE {self._p(pattern, fold)})" if self.spark else f"regexp_matches({x}, {self._p(pattern, fold)})"

    def sub(self, x: str, pattern: str, to: str = "", fold: bool = False) -> str:
        """to: text with \\1 for groups; $ and other characters are literal."""
        if self.spark:
            out, i = "", 0
            while i < len(to):
                if to[i] == "\\" and i + 1 < len(to) and to[i + 1].isdigit():
                    out += "$" + to[i + 1]
                    i += 2
                    continue
                out += "\\" + to[i] if to[i] in "$\\" else to[i]
                i += 1
            return f"regexp_replace({x}, {self._p(pattern, fold)}, {self.lit(out)})"
        out = to.replace("\\", "\\\\")
        for g in range(10):
            out = out.replace(f"\\\\{g}", f"\\{g}")
        return f"regexp_replace({x}, {self._p(pattern, fold)}, {self.lit(out)}, 'g')"

    def group(self, x: str, pattern: str, k: int = 1, fold: bool = False) -> str:
        return f"regexp_extract({x}, {self._p(pattern, fold)}, {k})"

    def count(self, x: str, pattern: str, fold: bool = False) -> str:
        return f"regexp_count({x}, {self._p(pattern, fold)})" if self.spark else f"len(regexp_extract_all({x}, {self._p(pattern, fold)}))"

    def all(self, x: str, pattern: str, k: int = 0, fold: bool = False) -> str:
        return f"regexp_extract_all({x}, {self._p(pattern, fold)}, {k})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})" if self.spark else f"string_split_regex({x}, {self.lit(pattern)})"

    def chars(self, x: str, names: str) -> str:
        """How many characters of x are in names."""
        return f"(length({x}) - length(translate({x}, {self.lit(names)}, '')))"

    def times(self, x: str, text: str) -> str:
        """Non-overlapping occurrences of a text."""
        return f"((length({x}) - length(replace({x}, {self.lit(text)}, ''))) / {len(text)})" if self.spark else f"((length({x}) - length(replace({x}, {self.lit(text)}, ''))) // {len(text)})"

    def strip(self, x: str) -> str:
        """Without white space at its ends; only these are looked at."""
        return f"trim(BOTH {self.lit(BLANKS)} FROM {x})" if self.spark else f"trim({x}, {self.lit(BLANKS)})"

    def is_upper(self, x: str) -> str:
        return f"(upper({x}) = {x} AND lower({x}) <> {x})"

    def is_lower(self, x: str) -> str:
        return f"(lower({x}) = {x} AND upper({x}) <> {x})"

    def first(self, x: str) -> str:
        return f"substr({x}, 1, 1)"

    def last(self, x: str) -> str:
        return f"right({x}, 1)"

    def each(self, items: str, var: str, body: str) -> str:
        return f"transform({items}, {var} -> {body})" if self.spark else f"list_transform({items}, lambda {var}: {body})"

    def keep(self, items: str, var: str, body: str) -> str:
        return f"filter({items}, {var} -> {body})" if self.spark else f"list_filter({items}, lambda {var}: {body})"

    def fold(self, items: str, start: str, acc: str, var: str, body: str) -> str:
        """items folded from the left: body makes the next acc from acc and var."""
        return f"aggregate({items}, {start}, ({acc}, {var}) -> {body})" if self.spark else f"list_reduce({items}, lambda {acc}, {var}: {body}, {start})"

    def numbers(self, n: str) -> str:
        """1 to n; nothing for 0."""
        return f"filter(sequence(0, {n}), k_ -> k_ > 0)" if self.spark else f"range(1, {n} + 1)"

    def at(self, items: str, k: str) -> str:
        """The k-th item from 1, or from the end for a negative k."""
        return f"element_at({items}, {k})" if self.spark else f"({items})[{k}]"

    def append(self, items: str, x: str) -> str:
        return f"concat({items}, array({x}))" if self.spark else f"list_append({items}, {x})"

    def doubles(self) -> str:
        """An empty array of doubles."""
        return "CAST(array() AS ARRAY<DOUBLE>)" if self.spark else "CAST([] AS DOUBLE[])"

    def gathered(self, value: str, order: str) -> str:
        """Ordered aggregation into an array."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), s -> s.v)" if self.spark else f"list({value} ORDER BY {order})"

    def record(self, **fields: str) -> str:
        return f"struct({', '.join(f'{v} AS {k}' for k, v in fields.items())})" if self.spark else "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def rows(self, *arrays: str) -> str:
        """A row for each item of the arrays, as a column."""
        both = f"flatten({self.array(*arrays)})"
        return f"explode({both})" if self.spark else f"unnest({both})"

    def size(self, items: str) -> str:
        return f"size({items})" if self.spark else f"len({items})"

    def join(self, items: str, sep: str) -> str:
        return f"array_join({items}, {self.lit(sep)})" if self.spark else f"array_to_string({items}, {self.lit(sep)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def texts(self, names) -> str:
        return self.array(*(self.lit(n) for n in names))

    def member(self, x: str, names) -> str:
        return f"{x} IN ({', '.join(self.lit(n) for n in names)})"

    def newline(self) -> str:
        return "char(10)" if self.spark else "chr(10)"

    def gather(self, value: str, order: str, sep: str) -> str:
        """Ordered string aggregation; sep is SQL."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), s -> s.v), {sep})"
        return f"string_agg({value}, {sep} ORDER BY {order})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)" if self.spark else f"round_even({x}, 0)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def once(self, source: str, **columns: str) -> str:
        """source with more columns that are worked out once.

        Spark pushes a filter below the projection that makes its columns and writes their expressions into it, over and
        over; rows of a generator are a line it doesn't cross. With one element for each row, the generator adds none.
        """
        if not self.spark:
            return f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({source}) AS once_"
        return f"SELECT once_.*, {', '.join(columns)} FROM ({source}) AS once_ LATERAL VIEW inline(array(struct({', '.join(columns.values())}))) made_ AS {', '.join(columns)}"

    def total(self, terms: list[tuple[str, str]]) -> str:
        """Sum of the values whose condition holds."""
        return "(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in terms) + ")"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")
