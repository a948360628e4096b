"""Secrets in notes: fixed patterns, and strings that zstandard finds new where secrets are spoken of."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import common

NOVELTY = 0.6  # marginal compressed bytes per byte from which a string is reported
HEX_NOVELTY = 0.35  # the same for strings of hex digits, which can't carry more than 0.5
AROUND = 400  # code points of surrounding text a candidate is measured against
SHORTEST = 16  # code points of a candidate, at least

# The patterns of plain secrets, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

# Words of a sensitive context.
CONTEXT_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api key", "credential", "private key", "access key", "bearer", "authorization")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.ASCII | re.IGNORECASE)
KEY_BEGINS, KEY_ENDS = (re.compile(rf"-{{4,}}\x20?{w}\b[^\n-]*PRIVATE KEY[^\n-]*-{{4,}}", re.ASCII | re.IGNORECASE) for w in ("BEGIN", "END"))
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}", re.ASCII)
HEX_DIGITS = re.compile(r"[0-9A-F-]+|[0-9a-f-]+", re.ASCII)
# A value given to a sensitive word, with signs that other candidates don't have.
VALUE = re.compile(
    rf"""(?:{"|".join(map(re.escape, CONTEXT_WORDS))})["']?\x20*[:=]\x20*(["']?)([^\s"'`,;<>()\[\]{{}}]{{12,}})""", re.ASCII | re.IGNORECASE
)
SIGN, VARIABLE = re.compile(r"[!@#$%^&*~?]"), re.compile(r"[$%@]\w+%?\Z", re.ASCII)
OPENS = re.compile(r"""[:=]\s*[|>]?[+-]?\s*\Z""", re.ASCII)  # a line whose value is on the next ones

# Identifiers and words common in code, which prime the compressor.
IDENTIFIERS = (
    "access account address application argument array attribute authorization backend base64 bearer boolean bucket "
    "buffer bytes callback certificate character class client cluster collection column command commit config "
    "configuration connection constant content context controller cookie credential database default delete description "
    "dictionary directory document domain element encoding endpoint environment error exception export expression field "
    "filename format frontend function generate handler header hostname identifier implementation import index "
    "initialize instance integer interface iterator javascript keyword language length library license localhost "
    "manager memory message metadata method middleware module namespace network notification number object operation "
    "option package parameter parser password path pattern permission pipeline plugin pointer policy private process "
    "production project property protocol provider public python query random record reference register repository "
    "request resource response result return schema script secret security select sequence serializer server service "
    "session setting signature source static status storage stream string structure subscription system table template "
    "temporary thread timeout timestamp token transaction transform undefined update upload username validate value "
    "variable version visible warning webhook website window workspace 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)

SECRETS = "vault string, path string, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


class Novelty:
    """Marginal compressed size against a dictionary of identifiers and the text around."""

    def __init__(self) -> None:
        import zstandard

        words = IDENTIFIERS.split()
        primer = " ".join([*words, *(w.upper() for w in words), *("_".join(p) for p in zip(words, words[7:], strict=False))])
        # Compressible text in front keeps the compressor from storing a short text as it is.  The size of
        # a short text jumps by some bytes with the code tables chosen, so several fronts are tried.
        self.ahead = [" ".join(words[k::5]).encode() for k in range(5)]
        dictionary = zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            19, write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        self.compressor = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def of(self, candidate: str, before: str, after: str) -> float:
        """The median over the fronts, so that neither lucky nor unlucky code tables decide."""
        around, piece = (before + after).encode("utf-8", "surrogatepass") + b"\n", candidate.encode()
        size = lambda data: len(self.compressor.compress(data))
        extra = sorted(size(ahead + around + piece) - size(ahead + around) for ahead in self.ahead)
        return extra[len(extra) // 2] / len(piece)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the plain secrets, by start, then kind as listed."""
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(text: str, first: int) -> Iterator[tuple[int, int]]:
    """Lines from position ``first`` on that hold a sensitive word, or the value of a line that does and ends with ``:`` or ``=``.

    The value is the next line that is not blank, and all further lines indented deeper than the key's.
    """
    key, value_due, at = None, False, first
    for line in text[first:].split("\n"):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            continue
        indent = len(line) - len(line.lstrip())
        inside = key is not None and (value_due or indent > key)
        word, value_due = CONTEXT.search(line), False
        if not inside:
            key = None
        if word and OPENS.search(bare):
            key, value_due = indent if key is None else min(key, indent), True
        if word or inside:
            yield start, start + len(line)


def contexts(text: str) -> list[tuple[int, int]]:
    """Whole lines with a sensitive word, lines below that give its value, and blocks of private keys (one without end goes to the end of the text)."""
    out, word = [], CONTEXT.search(text)
    if word:
        out += _blocks(text, text.rfind("\n", 0, word.start()) + 1)
    begins = KEY_BEGINS.search(text)
    while begins:
        ends = KEY_ENDS.search(text, begins.end())
        end = ends.end() if ends else len(text)
        out.append((begins.start(), end))
        begins = KEY_BEGINS.search(text, end)
    return _merged(out)


def novel_spans(text: str, known: list[tuple[int, int, str]], novelty: Novelty, low: str | None = None) -> list[tuple[int, int, float]]:
    """Strings in a sensitive context, apart from known ones, that the text around and the dictionary don't explain."""
    low = text.lower() if low is None else low
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out, within, taken = [], contexts(text), _merged([(s, e) for s, e, _ in known])
    starts, taken_starts = [s for s, _ in within], [s for s, _ in taken]

    def judge(a: int, b: int) -> None:
        piece = text[a:b]
        if re.search(r"[0-9]", piece) and re.search(r"[A-Za-z]", piece):
            score = novelty.of(piece, text[max(0, a - AROUND) : a], text[b : b + AROUND])
            if score >= (HEX_NOVELTY if HEX_DIGITS.fullmatch(piece) else NOVELTY):
                out.append((a, b, score))

    # A value with signs is judged as a whole, unless a known span covers it.
    for found in VALUE.finditer(text, starts[0]) if within else ():
        a, b = found.span(2)
        piece = found[2].rstrip(".?!:") if not found[1] else found[2]
        last = bisect_right(taken_starts, a) - 1
        covered = last >= 0 and a + len(piece) <= taken[last][1]
        if SIGN.search(piece) and not VARIABLE.match(piece) and "://" not in piece and not covered:
            judge(a, a + len(piece))
    taken = _merged(taken + [(a, b) for a, b, _ in out])
    taken_starts = [s for s, _ in taken]
    # Candidates are those of the whole text, so that none is cut at the edge of a context.
    for found in CANDIDATE.finditer(text, starts[0]) if within else ():
        a, b = found.span()
        k, last = bisect_right(starts, b - 1) - 1, bisect_right(taken_starts, b - 1) - 1
        if within[k][1] > a and not (last >= 0 and a < taken[last][1]):
            judge(a, b)
    return sorted(out)


def find_secrets(notes: DataFrame) -> DataFrame:
    """``vault, path, spans`` of every note: its secrets, by start, then kind.

    The kinds ``assign``, ``access`` and ``hex`` come from fixed patterns, leftmost and without overlap
    in each kind.  ``novel`` adds strings of 16 or more code points with letters and
    digits on a line with a sensitive word, however long, on the lines that give such a line's value
    (``secret:`` with text below), or in the block of a private key; and values of 12 or more with
    ``!``, ``@``, ``$`` and the like, given to a sensitive word on its line.  Each is
    compressed with and without the 400 code points before and after
    it, by a zstandard compressor primed with identifiers, and reported with its ``novelty`` when the
    marginal bytes are 0.6 or more of its own, or 0.35 for hex digits of one case, which carry 0.5 at
    most; the other kinds have no novelty.

    Positions are code points, the end is exclusive.  Empty and NULL texts have no spans; repeated
    rows get a row each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in common.pieces(batches):
            spans = []
            for text in batch.column(2).to_pylist():
                low = text.lower()
                known = base_spans(text, low)
                rows = [(s, e, k, None) for s, e, k in known] + [(s, e, "novel", v) for s, e, v in novel_spans(text, known, novelty, low)]
                rows.sort(key=lambda r: (r[0], KINDS.index(r[2])))
                spans.append([{"kind": k, "start": s, "end": e, "novelty": v} for s, e, k, v in rows])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["vault", "path", "spans"])

    return common.keyed(notes).mapInArrow(run, SECRETS)
