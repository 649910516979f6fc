"""Declarative specs: what to export, how to join, what to load."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

# Spelled-out delimiters.
SPELLED_DELIMITERS = {
    r"\n": "\n",
    r"\t": "\t",
    r"\r": "\r",
    r"\b": "\b",
    r"\f": "\f",
    r"\'": "'",
    r"\"": '"',
    r"\\": "\\",
    "tab": "\t",
}

# Join words (without JOIN) -> what is joined, and how.
JOIN_KINDS = {
    "": ("table", "inner"),
    "INNER": ("table", "inner"),
    "LEFT": ("table", "left"),
    "RIGHT": ("table", "right"),
    "FULL": ("table", "full"),
    "OUTER": ("table", "full"),
    "LEFT OUTER": ("table", "left"),
    "RIGHT OUTER": ("table", "right"),
    "FULL OUTER": ("table", "full"),
    "CROSS": ("product", "inner"),
    "SEMI": ("table", "left_semi"),
    "LEFT SEMI": ("table", "left_semi"),
    "ANTI": ("table", "left_anti"),
    "LEFT ANTI": ("table", "left_anti"),
    "ANY": ("any", "inner"),
    "LEFT ANY": ("any", "left"),
    "ANY LEFT": ("any", "left"),
    "ANY INNER": ("any", "inner"),
    "INNER ANY": ("any", "inner"),
    "GLOBAL": ("global", "inner"),
    "GLOBAL LEFT": ("global", "left"),
    "ARRAY": ("array", "inner"),
    "LEFT ARRAY": ("array", "left"),
}

PREVIEW_ROWS = 100
TABLE_HEAD_ROWS = 1000
SAMPLE_ROWS = 1000
BYTES_PER_ROW = 100
MAX_BAD_ROWS = 10
MAX_BAD_RATIO = 0.01


# A literal, a quoted name, a word, an operator of two signs, or one sign.
CONDITION_TOKEN = re.compile(r"'(?:[^']|'')*'|`(?:[^`]|``)*`|\"[^\"]*\"|[\w$]+|<=>|[<>=!]=|<>|\S")


def condition_tokens(condition: str) -> list[str]:
    return CONDITION_TOKEN.findall(condition)


def is_name(token: str) -> bool:
    return token[0] in '`"' or re.fullmatch(r"[A-Za-z_]\w*", token) is not None


def plain_name(token: str) -> str:
    return token[1:-1].replace("``", "`") if token[0] in '`"' else token


def is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


def decode_delimiter(text: str | None, multi_char: bool = False) -> str:
    """One delimiter character from its spelling.

    A single blank is a valid delimiter; a longer run of blanks is not. Of
    other longer texts only the first character counts, unless ``multi_char``.
    """
    if not text:
        raise ValueError("the delimiter must be a non-empty string")
    if text in SPELLED_DELIMITERS:
        return SPELLED_DELIMITERS[text]
    if len(text) > 1 and not text.strip():
        raise ValueError("a blank delimiter must be a single character")
    return text if multi_char else text[0]


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused_name(name: str, *column_lists) -> str:
    """The name, with as many ``_`` behind it as it takes to be in none of the lists."""
    taken = {c.lower() for columns in column_lists for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_reference(reference: str, main_table: str) -> tuple[str, str]:
    """``table.column`` cut at the first dot; a bare name belongs to the main table."""
    table, dot, column = reference.replace('"', "").partition(".")
    return (table, column) if dot else (main_table, table)


@dataclass(frozen=True)
class JoinSpec:
    """One join of the chain.

    Give either ``condition`` (any SQL condition over ``table.column`` names)
    or ``pairs`` of (local column, joined column). ``order_by`` decides which
    match an ANY join keeps; ``array_column`` names what an ARRAY join unfolds.
    """

    table: str
    kind: str | None = None
    condition: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    order_by: tuple[str, ...] = ()
    array_column: str | None = None

    @property
    def mode(self) -> tuple[str, str]:
        """What is joined (table, product, any, global, array) and how; blank is a left join."""
        if is_blank(self.kind):
            return "table", "left"
        mode = JOIN_KINDS.get(" ".join(w for w in self.kind.upper().split() if w != "JOIN"))
        if mode is None:
            raise ValueError(f"unknown join type {self.kind!r}")
        return mode

    @property
    def is_valid(self) -> bool:
        """Table, type and condition are all present."""
        has_condition = not is_blank(self.condition) or bool(self.pairs)
        return not is_blank(self.table) and not is_blank(self.kind) and has_condition

    def equal_terms(
        self, main_table: str, right_columns: Sequence[str] = (), left_columns: Sequence[str] = ()
    ) -> tuple[list[tuple[str, str, str]], bool]:
        """(left table, left column, joined column) of each plain column equality
        that must hold, and whether these are the whole condition.

        A name without a table is the joined table's if only that has it, else
        the main table's.
        """
        if self.pairs:
            return [(*split_reference(local, main_table), right) for local, right in self.pairs], True
        tokens = condition_tokens(self.condition or "")
        while tokens[:1] == ["("] and tokens[-1:] == [")"] and "(" not in tokens[1:] and ")" not in tokens[1:-1]:
            tokens = tokens[1:-1]
        if not tokens or {"(", ")", "OR", "BETWEEN", "CASE", "NOT"} & {t.upper() for t in tokens}:
            return [], False
        terms: list[list[str]] = [[]]
        for token in tokens:
            if token.upper() == "AND":
                terms.append([])
            else:
                terms[-1].append(token)

        def reference(part: list[str]) -> tuple[str, str] | None:
            if not all(is_name(t) if i % 2 == 0 else t == "." for i, t in enumerate(part)) or len(part) not in (1, 3):
                return None
            names = [plain_name(t) for t in part[::2]]
            if len(names) == 2:
                return names[0], names[1]
            only_right = names[0] in right_columns and names[0] not in left_columns
            return (self.table if only_right else main_table), names[0]

        found, whole = [], True
        for term in terms:
            at = term.index("=") if term.count("=") == 1 else 0
            a, b = (reference(term[:at]), reference(term[at + 1 :])) if at else (None, None)
            if a and b and b[0] == self.table != a[0]:
                found.append((*a, b[1]))
            elif a and b and a[0] == self.table != b[0]:
                found.append((*b, a[1]))
            else:
                whole = False
        return found, whole

    def equal_pairs(
        self, main_table: str, right_columns: Sequence[str] = (), left_columns: Sequence[str] = ()
    ) -> list[tuple[str, str, str]] | None:
        """``equal_terms`` if the condition is nothing else."""
        found, whole = self.equal_terms(main_table, right_columns, left_columns)
        return found if found and whole else None


@dataclass(frozen=True)
class ExportSpec:
    """Which columns of which joined tables to export, and how many rows."""

    table: str
    columns: tuple[str, ...]
    joins: tuple[JoinSpec, ...] = ()
    limit: int | None = None
    delimiter: str | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if is_blank(self.table):
            raise ValueError("the table name must not be blank")
        kept = tuple(c for c in self.columns if not is_blank(c))
        if not kept:
            raise ValueError("at least one column must be selected")
        object.__setattr__(self, "columns", kept)
        object.__setattr__(self, "joins", tuple(j for j in self.joins if not is_blank(j.table)))

    @property
    def separator(self) -> str:
        return "," if self.delimiter is None else decode_delimiter(self.delimiter)

    @property
    def counts_rows(self) -> bool:
        """The only projected column is ``COUNT(*)``, maybe table-qualified."""
        if len(self.columns) != 1:
            return False
        column = re.sub(r'[`"]', "", self.columns[0]).strip().upper()
        return column in ("COUNT(*)", f"{self.table.upper()}.COUNT(*)")


@dataclass(frozen=True)
class LoadSpec:
    """Which file columns go to which table, with which types.

    With ``infer`` a new table gets the types that fit the whole file, except
    for the columns in ``column_types``.
    """

    table: str
    create: bool = False
    delimiter: str = ","
    column_types: Mapping[str, str] | None = None
    has_header: bool = True
    columns: tuple[str, ...] | None = None
    max_bad_rows: int = MAX_BAD_ROWS
    max_bad_ratio: float = MAX_BAD_RATIO
    location: str | None = None
    infer: bool = False

    def __post_init__(self):
        if is_blank(self.table):
            raise ValueError("the table name must not be blank")

    @property
    def separator(self) -> str:
        return decode_delimiter(self.delimiter)
