"""From bytes to text: declared charsets, a bigram model for undeclared ones, encoded words, mailboxes.

Written after RFC 2047 (encoded words), RFC 2045 (charsets) and RFC 5322 (address lists).
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailspark import lexicon as lx

#: Charsets that the bigram model tells apart unless told otherwise: those of mail that names none, or a wrong one.
STATISTICAL = ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "cp850", "mac-roman")
#: Fewer bytes are too few to tell a charset by.
LEAST_BYTES = 40
PAIRS = 1 << 17


def _strictly(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(charset)
    except (LookupError, UnicodeError):
        return None


def trusted(declared: str | None) -> tuple[str, ...]:
    """What a declaration stands for. A national charset is read as the larger sets that its senders really use; one
    that fits any bytes says nothing."""
    name = (declared or "").strip().lower().replace("_", "-")
    if not name or name in lx.PERMISSIVE_CHARSETS:
        return ()
    return (*lx.GB_FALLBACKS, name) if name in lx.GB_DECLARED else (name,)


def to_text(data: bytes, declared: str | None = None, model: Bigrams | None = None) -> str:
    """The text of some bytes; never an error.

    A charset that is named and fits is believed, unless ``model`` finds the bytes unlike it. Without a name, or where
    it does not fit, the model decides; without a model, or where no text of its kind fits, the usual charsets in their
    order, then what was declared though it fits anything. Bytes that fit nothing become replacement characters.
    """
    if data.isascii() and b"\0" not in data:
        return data.decode("ascii")
    if model is not None and len(data) >= LEAST_BYTES and (found := model.charset(data)):
        return data.decode(found)
    last = () if trusted(declared) else ((declared or "").strip(),)
    for charset in (*trusted(declared), *lx.DEFAULT_CHARSETS, *last):
        if charset and (text := _strictly(data, charset)) is not None:
            return text
    return data.decode("utf-8", "replace")


# --- charsets by their bytes ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bigrams:
    """How likely each byte follows each other one, in each charset, and how likely text of that kind is at least."""

    charsets: tuple[str, ...]
    logs: np.ndarray  # charsets x PAIRS
    least: float      # mean log-likelihood of a byte, in natural logs

    def charset(self, data: bytes) -> str | None:
        """The charset that fits and makes the bytes most likely; of equals the first. None if none is likely enough.

        Bytes beyond ASCII that are valid UTF-8 throughout are hardly anything else, whatever the text is like.
        """
        if "utf-8" in self.charsets and b"\0" not in data and _strictly(data, "utf-8") is not None:
            return "utf-8"
        pairs = np.bincount(_pairs(data), minlength=PAIRS)
        seen = np.flatnonzero(pairs)
        likely = self.logs[:, seen] @ pairs[seen] / max(len(data) - 1, 1)
        for k in np.argsort(-likely, kind="stable"):
            if likely[k] >= self.least and _strictly(data, self.charsets[k]) is not None:
                return self.charsets[k]
        return None


def _pairs(data: bytes) -> np.ndarray:
    """Pairs of neighbours, told apart by whether they begin at an even place: wide charsets differ in that alone."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return (np.arange(len(b) - 1) & 1) << 16 | b[:-1] << 8 | b[1:]


def learn_charsets(texts: DataFrame, charsets: Sequence[str] = STATISTICAL, margin: float = 0.3) -> Bigrams:
    """A model from ``texts`` (text): every text is encoded in every charset that holds it, and pairs of bytes counted,
    as it is written and in capitals.

    One table of PAIRS counts for each charset comes to the driver, whatever the texts are. Smoothing gives pairs
    that never occur one count in each row of the table. Bytes are text of a kind if they are likelier by ``margin`` (in
    natural logs a byte) than bytes drawn at random. Null texts and empty tables are allowed; without texts all charsets
    are equally likely, and the first that fits is taken.
    """
    charsets = tuple(charsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(charsets), PAIRS), np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                for written, (k, charset) in product(((text or ""), (text or "").upper()), enumerate(charsets)):
                    try:
                        data = written.encode(charset)
                    except UnicodeError:
                        continue
                    if len(data) > 1:
                        counts[k] += np.bincount(_pairs(data), minlength=PAIRS)
        which, pair = np.nonzero(counts)
        yield pa.record_batch([pa.array(which), pa.array(pair), pa.array(counts[which, pair])], names=["which", "pair", "n"])

    table = texts.select("text").mapInArrow(run, "which long, pair long, n long").groupBy("which", "pair").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(charsets), PAIRS))
    counts[table["which"].to_numpy(), table["pair"].to_numpy()] = table["n"].to_numpy()
    smooth = counts.reshape(len(charsets), 512, 256) + 1 / 256
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True)).reshape(len(charsets), -1)
    return Bigrams(charsets, logs, margin - np.log(256) if counts.any() else -np.inf)


def decoded(rows: DataFrame, column: str, declared: str, model: Bigrams | None = None) -> DataFrame:
    """``rows`` with the text of the bytes in ``column`` in their place; the column ``declared`` names a charset, or not.
    Null bytes stay null."""
    shared, names = rows.sparkSession.sparkContext.broadcast(model), rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if data is None else to_text(data, name, shared.value).encode("utf-8", "replace").decode()
                     for data, name in zip(batch[column].to_pylist(), batch[declared].to_pylist())]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.record_batch(columns, names=names)

    fields = [f"`{f.name}` {'string' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join(fields))


# --- header words -----------------------------------------------------------------------------------------------

_ENCODED_WORD = re.compile(r"=\?(?P<charset>[^?*\s]+)(?:\*[^?\s]*)?\?(?P<how>[BbQq])\?(?P<body>[^?]*)\?=")


def _q_bytes(body: bytes) -> bytes:
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: binascii.unhexlify(m[1]), body.replace(b"_", b" "))


def _b_bytes(body: bytes) -> bytes:
    kept = re.sub(rb"[^A-Za-z0-9+/]", b"", body)
    return binascii.a2b_base64(kept[:len(kept) - (len(kept) % 4 == 1)] + b"=" * (-len(kept) % 4))


def header_bytes(value: str) -> bytes:
    """A header as it was sent: the mail parser keeps bytes beyond ASCII as lone surrogates."""
    return value.encode("utf-8", "surrogateescape")


def header_text(value: str | None, model: Bigrams | None = None) -> str:
    """A header with its encoded words and its bare bytes read.

    Neighbouring encoded words of one charset are one run of bytes, as senders cut characters in two; white space
    between encoded words is dropped. A word that is not what it says stays as it is written.
    """
    if not value:
        return ""
    out: list[str] = []
    run, charset, end = b"", "", 0
    for word in _ENCODED_WORD.finditer(value):
        between = value[end:word.start()]
        body = word["body"].encode("ascii", "ignore")
        data = _q_bytes(body) if word["how"] in "Qq" else _b_bytes(body)
        if between.strip() or not end or word["charset"].lower() != charset:
            out += [to_text(run, charset, model)] if run else []
            out += [to_text(header_bytes(between), None, model)] if between.strip() or not end else []
            run, charset = b"", word["charset"].lower()
        run, end = run + data, word.end()
    out += [to_text(run, charset, model)] if run else []
    out.append(to_text(header_bytes(value[end:]), None, model))
    return "".join(out).strip().encode("utf-8", "replace").decode("utf-8")


# --- address lists ----------------------------------------------------------------------------------------------

#: An entry of an address list ends at a comma or semicolon outside quotes, comments and angle brackets.
_ENTRY = re.compile(r'(?:"(?:[^"\\]|\\.)*"|\((?:[^()\\]|\\.)*\)|<[^<>]*>|[^,;])+')
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|\(((?:[^()\\]|\\.)*)\)')
_ANGLE = re.compile(r'^(?P<name>(?:"(?:[^"\\]|\\.)*"|[^<"])*)<(?P<address>[^<>]*)>')


@dataclass(frozen=True)
class Mailbox:
    address: str
    name: str


def mailboxes(value: str | None, model: Bigrams | None = None) -> list[Mailbox]:
    """The mailboxes of an address header in their order, those without any address left out.

    Groups are flattened. Where only the display name holds an address, senders have swapped the two.
    """
    found = []
    for entry in _ENTRY.findall(value or ""):
        comments: list[str] = []
        bare = _COMMENT.sub(lambda m: m[1] or (comments.append(m[2]) or " "), entry).strip()
        if (angle := _ANGLE.match(bare)) is not None:
            name, address = angle["name"], angle["address"]
        else:
            name, address = "", bare.rpartition(":")[2]  # what stands before a colon names a group
        name = name.strip()
        name = re.sub(r"\\(.)", r"\1", name[1:-1] if re.fullmatch('".*"', name, re.S) else name) or " ".join(comments)
        address = "".join(address.split()) if "@" in address else ""
        swapped = not address and "@" in name
        if address or swapped:
            found.append(Mailbox((name if swapped else address).strip().lower(), "" if swapped else header_text(name, model)))
    return found
