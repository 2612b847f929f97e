"""Any number of rules from a table, against source text.

The built-in rules are one constant of the plan. A rule table of an organisation is data: it may hold
many thousand rows, and patterns that nobody has tried. Here its rules become an inverted index: for
every rule the literals that each of its matches must contain, all of them in one automaton. A pass
over the folded text of a file finds every literal in it, and so the few rules that can match there;
only these are compiled and run, with the regular expressions of Python, whose syntax the rules are
written in. Nothing of a pattern is translated, a line of any length needs no deep stack, and a rule
that does not compile is a row of ``rejected_rules`` and never the end of a scan.

The index is sent to the tasks in shards of bounded size; each shard is a narrow pass over the files.
A rule for all files whose pattern is one word needs no search: it matches the lines that hold its word.
Many such rules are joined to the words of the lines, so their number costs rows of a join and no passes.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import translate
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetgrid.functions.folding import spellings
from vetgrid.functions.regex import can_cross_lines, required_literals
from vetgrid.session import stage_table
from vetgrid.sources.records import REQUIRED_FIELDS, complete_rules

SHARD_BYTES = 8 << 20  # text of the rules that one pass sends to the tasks
ROWS_OUT = 4096  # matches that a task gathers before it hands them on
BYTES_OUT = 8 << 20  # text of the lines that a task gathers before it hands them on
COMPILED = 1 << 15  # patterns that a worker keeps compiled, some ten megabytes
FEW_WORDS = 2000  # so many rules of one word go into the index like all others
SIEVE = 1 << 27  # bits that tell words of rules from others: 16 MB; a fuller sieve lets more words into the join
STOPPED = 1 << 17  # words that a task knows to be in no rule
CHUNK = 1 << 21  # bits of the sieve that one task sets

_FIELDS = ("rule_id", "owasp_category", "severity", "title", "description", "suggested_fix")
_FLAGS = re.IGNORECASE | re.MULTILINE
_ODD_LETTERS = str.maketrans({"ſ": "s", "K": "k", "ı": "i", "İ": "i"})
_SWITCHED_OFF = re.compile(r"#\s*owasp-ignore:\s*([\w\-,\s]+)")
_WORDS = re.compile(r"\w+")


# -- the rule table ---------------------------------------------------------------------------


def _problem(pattern: str | None) -> str | None:
    if pattern is None or spellings().word_of(pattern) is not None:
        return None
    try:
        re.compile(pattern, _FLAGS)
    except (re.error, OverflowError, RecursionError) as error:
        return str(error) or type(error).__name__
    return None


def _rule_problem(pattern: str, exclude: str | None) -> str | None:
    for name, text in (("pattern", pattern), ("exclude_pattern", exclude)):
        found = _problem(text)
        if found:
            return f"{name}: {found}"
    return None


def checked_rules(records: DataFrame) -> DataFrame:
    """Complete rule records with ``problem``: why a pattern does not compile, or null."""
    complete = complete_rules(records)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems = map(_rule_problem, *(batch.column(n).to_pylist() for n in ("pattern", "exclude_pattern")))
            yield batch.append_column("problem", pa.array(problems, pa.string()))

    return complete.mapInArrow(check, T.StructType([*complete.schema.fields, T.StructField("problem", T.StringType())]))


def rejected_rules(records: DataFrame) -> DataFrame:
    """``(id, reason)`` for every record that no scan uses: a field is missing, or a pattern does not compile."""
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in REQUIRED_FIELDS]))
    lacking = records.select("id", F.concat(F.lit("missing: "), F.array_join(missing, ", ")).alias("reason")).filter(
        F.col("reason") != "missing: ")
    broken = checked_rules(records).filter("problem is not null").select("id", F.col("problem").alias("reason"))
    return lacking.unionByName(broken)


# -- the index --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    """A rule as the tasks need it."""

    fields: tuple[str, ...]  # in the order of _FIELDS
    pattern: str
    exclude: str | None
    glob: str
    literals: list[tuple[str, ...]] | None = None  # as of ``required_literals``; worked out here if not given
    whole_word: bool = False  # the first literal stands between word boundaries


_WHOLE_WORD = re.compile(r"\\b[^\W_\d]+\\b", re.UNICODE)


def _is_whole_word(pattern: str, literals: Sequence[Sequence[str]]) -> bool:
    """The pattern is one word of letters and nothing else, so all of it is the first literal."""
    return bool(_WHOLE_WORD.fullmatch(pattern)) and len(literals) == 1 and [pattern[2:-2].lower()] == list(literals[0])


class Index:
    """The rules that can match a text, by the literals it holds."""

    def __init__(self, entries: Sequence[Entry]):
        self.entries = entries
        self.loose: list[int] = []  # nothing is known of their matches
        self.others: list[list[tuple[str, ...]]] = []
        self.in_line: list[tuple[str, ...]] = []  # one of them stands in each matched line; empty if that is not known
        by_literal: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for number, entry in enumerate(entries):
            groups = required_literals(entry.pattern, "im") if entry.literals is None else entry.literals
            self.others.append(groups[1:])
            self.in_line.append(groups[0] if groups and not can_cross_lines(entry.pattern) else ())
            for literal in groups[0] if groups else ():
                by_literal[literal][entry.whole_word].append(number)
            if not groups:
                self.loose.append(number)
        self.automaton = None
        if by_literal:
            self.automaton = ahocorasick.Automaton()
            for literal, numbers in by_literal.items():
                self.automaton.add_word(literal, (len(literal), *numbers))
            self.automaton.make_automaton()

    def candidates(self, text: str, folded: str | None = None) -> list[int]:
        folded = _folded(text) if folded is None else folded
        found = set(self.loose)
        if self.automaton is not None:
            seen: set[int] = set()
            for end, (size, anywhere, whole) in self.automaton.iter(folded):
                if anywhere and id(anywhere) not in seen:  # one list for each literal
                    seen.add(id(anywhere))
                    found.update(anywhere)
                if whole and id(whole) not in seen and _stands_alone(folded, end + 1 - size, end + 1):
                    seen.add(id(whole))
                    found.update(whole)
        return sorted(n for n in found if all(any(x in folded for x in group) for group in self.others[n]))


def _letter(c: str) -> bool:
    """A word character before and after folding; odd characters are left to the pattern."""
    return "a" <= c <= "z" or "0" <= c <= "9" or c == "_"


def _stands_alone(text: str, start: int, end: int) -> bool:
    return not (start > 0 and _letter(text[start - 1])) and not (end < len(text) and _letter(text[end]))


def _folded(text: str) -> str:
    return text.translate(_ODD_LETTERS).lower()


_held: dict[str, Index] = {}


def _index(shard: str, shared: Broadcast) -> Index:
    """The index of a shard, built once in a worker and not in each of its tasks; one is held at a time."""
    if shard not in _held:
        _held.clear()
        _held[shard] = Index(shared.value)
    return _held[shard]


@lru_cache(COMPILED)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, _FLAGS)


@lru_cache(4096)
def _glob(glob: str) -> re.Pattern:
    return re.compile(translate(glob))


def _codes(line: str | None) -> set[str]:
    found = _SWITCHED_OFF.search(line or "")
    return {c.strip() for c in found[1].split(",")} if found else set()


def matches(text: str, lines: list[str], entry: Entry, folded: Sequence[str] = (),
            literals: Sequence[str] = ()) -> Iterator[tuple[int, str]]:
    """``(line number, content)`` for each line with a match or on which a match of the whole text starts.

    With ``literals`` (see ``Index.in_line``) no match leaves its line, and only the lines whose ``folded`` form
    holds one of them are searched.
    """
    pattern = _compiled(entry.pattern)
    exclude = _compiled(entry.exclude) if entry.exclude is not None else None
    if literals:
        for number, line in enumerate(folded, 1):
            if any(x in line for x in literals):
                shown = lines[number - 1]
                if pattern.search(shown) is not None and not (exclude and exclude.search(shown)):
                    yield number, shown
        return
    begun: dict[int, str] = {}
    at, number = 0, 1
    for match in pattern.finditer(text):
        number += text.count("\n", at, match.start())
        at = match.start()
        begun.setdefault(number, match[0].split("\n", 1)[0])
    for number, line in enumerate(lines, 1):
        in_line = pattern.search(line) is not None
        if (in_line or number in begun) and not (exclude and exclude.search(line)):
            yield number, line if in_line else begun[number]


def _snippet(lines: list[str], number: int, before: int = 1, after: int = 2) -> str:
    first = max(number - before, 1)
    return "\n".join(f"{n:4d} | {line}" for n, line in enumerate(lines[first - 1 : number + after], first))


def scan_with_rules(
    files: DataFrame,
    records: DataFrame,
    *,
    keep: Sequence[str] = ("path",),
    path: str = "path",
    content: str = "content",
    shard_bytes: int = SHARD_BYTES,
    few_words: int = FEW_WORDS,
) -> DataFrame:
    """Matches of the rules of ``records`` in the text of each row, with the columns of ``scan_text``.

    Records that lack a field or do not compile take no part, see ``rejected_rules``. Several records of
    one id are rules of their own. Without a usable rule the result is empty; a null text has no match.
    """
    schema = T.StructType([*[files.schema[c] for c in keep], *[T.StructField(c, T.StringType()) for c in _FIELDS],
                           T.StructField("line_number", T.IntegerType()), T.StructField("line_content", T.StringType()),
                           T.StructField("code_snippet", T.StringType())])
    usable = _usable(records)
    words = usable.filter("word is not null")
    count = words.count()
    parts = []
    if count > few_words:
        parts = [_scan_words(files, words, count, keep, content, schema)]
        usable = usable.filter("word is null")
    parts += [_scan(files, shard, keep, path, content, schema) for shard in _shards(usable, shard_bytes)]
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    return files.sparkSession.createDataFrame([], schema) if found is None else found


def _usable(records: DataFrame) -> DataFrame:
    """Rules that compile, with what the scan needs of their patterns, worked out once and not in every worker:
    ``word`` and ``mark``, its hash, for those of one word in all files, ``literals`` for the others."""
    names = ("problem", "literals", "word", "mark")
    types = ("string", "array<array<string>>", "string", "bigint")
    arrow = (pa.string(), pa.list_(pa.list_(pa.string())), pa.string(), pa.int64())

    def parse(pattern: pa.Array, exclude: pa.Array, glob: pa.Array) -> pa.Array:
        rows = []
        for text, other, name in zip(pattern.to_pylist(), exclude.to_pylist(), glob.to_pylist()):
            problem = _rule_problem(text, other)
            word = spellings().word_of(text) if other is None and name == "*" else None
            literals = None if problem or word is not None else [list(t) for t in required_literals(text, "im")]
            rows.append((problem, literals, word, None if word is None else _mark(word)))
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names)

    # Patterns are parsed on all cores and once, also where the optimizer would move the test below.
    parsed = F.arrow_udf(parse, ", ".join(map(" ".join, zip(names, types)))).asNondeterministic()
    complete = complete_rules(records).repartition(
        records.sparkSession.sparkContext.defaultParallelism * 2, "id", "pattern")
    checked = complete.withColumn("parsed", parsed("pattern", "exclude_pattern", "file_glob"))
    return stage_table(checked.filter("parsed.problem is null").select(*complete.columns, *[
        f"parsed.{n}" for n in names[1:]]), "rules")


def _shards(usable: DataFrame, limit: int) -> Iterator[list[Entry]]:
    """Rules in parts of at most ``limit`` bytes of text (one rule at least)."""
    shard: list[Entry] = []
    size = 0
    for r in usable.orderBy("id", "pattern").toLocalIterator():
        literals = required_literals(r.pattern, "im") if r.literals is None else [tuple(g) for g in r.literals]
        entry = Entry((r.id, r.owasp_category, r.severity, r.title, r.description, r.suggested_fix), r.pattern,
                      r.exclude_pattern, r.file_glob, literals, _is_whole_word(r.pattern, literals))
        own = sum(map(len, entry.fields)) + len(entry.pattern) + len(entry.exclude or "")
        if shard and size + own > limit:
            yield shard
            shard, size = [], 0
        shard.append(entry)
        size += own
    if shard:
        yield shard


# -- rules of one word ------------------------------------------------------------------------


def _mark(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


def _places(mark, bits: int) -> tuple:
    """The two places of a mark, or of an array of them, in a sieve of a power of two of ``bits``."""
    return mark & bits - 1, mark * 0x5BD1E995 >> 16 & bits - 1


def _sieve(rules: DataFrame, count: int) -> bytes:
    """A bitmap with two bits set for the ``mark`` of each rule: 16 bits a rule, ``SIEVE`` at most."""
    bits = min(SIEVE, max(CHUNK, 1 << (16 * count).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(batch.column("mark").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((places // CHUNK).astype(np.int32)), pa.array((places % CHUNK).astype(np.int32))], ["chunk", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        wanted = np.zeros(CHUNK, bool)
        wanted[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1],
                         "bits": pa.array([np.packbits(wanted, bitorder="little").tobytes()], pa.binary())})

    places = rules.select("mark").mapInArrow(place, "chunk int, bit int")
    result = bytearray(bits // 8)
    for r in places.groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect():
        result[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = r.bits
    return bytes(result)


def _passes(word: str, sieve: bytes) -> bool:
    a, b = _places(_mark(word), 8 * len(sieve))
    return bool(sieve[a >> 3] >> (a & 7) & sieve[b >> 3] >> (b & 7) & 1)


def _scan_words(files, rules, count, keep, content, schema) -> DataFrame:
    """Matches of rules of one word: a join of their words with those of the lines that pass a sieve.

    The texts are read once and stay where they are; what moves is a row for each match, with few others.
    """
    shared = files.sparkSession.sparkContext.broadcast(_sieve(rules, count))
    kept = [files.schema[c] for c in keep]
    lists = T.ArrayType(T.StringType())
    line_schema = T.StructType([*kept, *schema.fields[-3:], T.StructField("_codes", lists), T.StructField("_words", lists)])
    arrow = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, fold = shared.value, spellings().fold
        stopped: set[str] = set()  # words that the sieve stops, many of which come again

        def rows(batch: pa.RecordBatch, places: list[int], found: list[tuple]) -> pa.RecordBatch:
            own = batch.select(range(len(keep))).take(pa.array(places, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [*own.columns, *[pa.array(list(c), t) for c, t in zip(zip(*found), arrow)]], line_schema.names)

        for batch in batches:
            places: list[int] = []
            found: list[tuple] = []
            size = 0
            for place, value in enumerate(batch.column(len(keep))):
                text = value.as_py()
                if text is None:
                    continue
                lines = text.split("\n")
                for at, line in enumerate(fold(text).split("\n"), 1):
                    new = set(_WORDS.findall(line)) - stopped
                    words = [w for w in new if _passes(w, sieve)]
                    if len(words) < len(new):
                        if len(stopped) > STOPPED:
                            stopped.clear()
                        stopped.update(new.difference(words))
                    if not words:
                        continue
                    off = _codes(lines[at - 1]) | _codes(lines[at - 2] if at > 1 else None)
                    places.append(place)
                    found.append((at, lines[at - 1], _snippet(lines, at), list(off), words))
                    size += len(found[-1][1]) + len(found[-1][2])
                    if len(found) >= ROWS_OUT or size >= BYTES_OUT:
                        yield rows(batch, places, found)
                        places, found, size = [], [], 0
            if found:
                yield rows(batch, places, found)

    lines = files.select(*keep, F.col(content).alias("_content")).mapInArrow(run, line_schema)
    spoken = lines.select(*[c for c in line_schema.names if c != "_words"], F.explode("_words").alias("_word"))
    named = rules.select(F.col("id").alias("rule_id"), *_FIELDS[1:], F.col("word").alias("_word"))
    met = spoken.join(named, "_word").filter(~F.arrays_overlap("_codes", F.array("rule_id", "owasp_category")))
    return met.select(*schema.names)


# -- the other rules --------------------------------------------------------------------------


def _scan(files, entries, keep, path, content, schema) -> DataFrame:
    shared, shard = files.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex
    arrow = [pa.string()] * len(_FIELDS) + [pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shard, shared)

        def rows(batch: pa.RecordBatch, places: list[int], found: list[tuple]) -> pa.RecordBatch:
            kept = batch.select(range(len(keep))).take(pa.array(places, pa.int64()))
            columns = list(zip(*found)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(list(c), t) for c, t in zip(columns, arrow)]], schema.names)

        for batch in batches:
            places: list[int] = []
            found: list[tuple] = []
            for place in range(batch.num_rows):
                text = batch.column(len(keep) + 1)[place].as_py()
                if text is None:
                    continue
                name = (batch.column(len(keep))[place].as_py() or "").rsplit("/", 1)[-1]
                folded, lines = _folded(text), None
                for number in index.candidates(text, folded):
                    entry = index.entries[number]
                    if not _glob(entry.glob).match(name):
                        continue
                    if lines is None:
                        lines, folded_lines = text.split("\n"), folded.split("\n")
                    for at, shown in matches(text, lines, entry, folded_lines, index.in_line[number]):
                        off = _codes(lines[at - 1]) | _codes(lines[at - 2] if at > 1 else None)
                        if off.isdisjoint(entry.fields[:2]):
                            places.append(place)
                            found.append((*entry.fields, at, shown, _snippet(lines, at)))
                if len(found) >= ROWS_OUT:
                    yield rows(batch, places, found)
                    places, found = [], []
            if found:
                yield rows(batch, places, found)

    chosen = files.select(*keep, F.col(path).alias("_path"), F.col(content).alias("_content"))
    return chosen.mapInArrow(run, schema)
