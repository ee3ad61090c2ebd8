"""Personal data by anchor expansion: an Aho-Corasick pass, then local parsers."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import longs

# The kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "account", "ssn", "address", "url"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
                   r"(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|Number|NUMBER|no\.?|No\.?|nr\.?|Nr\.?|#))?[\s:#=]{1,3}"
                      r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[\s:#=]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_STREET = re.compile(r"([0-9]{1,5}[A-Za-z]?(?: [A-Z][\w.'-]*){1,4} )$")

# Anchors and what they lead to, in the cases in which people write them.
CUES = {"://": "url", "@": "email", "+": "phone", **{d: "digit" for d in "0123456789"}}
for _kind, _words in {"iban": ["iban"], "ssn": ["ssn", "social security number"],
                      "account": ["account", "acct"]}.items():
    for _w in _words:
        CUES |= {_w: _kind, _w.upper(): _kind, _w.capitalize(): _kind}
CUES |= {w: "address" for w in ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive")}


def automaton():
    import ahocorasick
    auto = ahocorasick.Automaton()
    for word, kind in CUES.items():
        auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str, auto) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, in order.

    Base kinds are leftmost and don't overlap within the kind: a parse starts no earlier than the
    last one of its kind ended, whether or not that one was valid. Digits need only be looked at
    where a run starts, since a parse takes whole runs.
    """
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)
    run_end = -1

    def add(kind: int, start: int, end: int, ok: bool) -> None:
        done[kind] = end
        if ok:
            out.append((start, kind, end))

    for last, (what, length) in auto.iter(text):
        start = last - length + 1
        if what == "digit":
            if start <= run_end:
                run_end = start + 1
                continue
            run_end = start + 1
            if start >= done[1] and (m := _IP.match(text, start)):
                add(1, start, m.end(), all(int(p) <= 255 for p in m.group().split(".")
                                           if len(p) < 400) and max(
                    len(p.lstrip("0")) for p in m.group().split(".")) <= 3)
            if start >= done[2] and (m := _CARD.match(text, start)):
                digits = m.group().replace(" ", "").replace("-", "")
                add(2, start, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
        elif what == "email":
            if m := _DOMAIN.match(text, start + 1):
                a = start
                while a > done[0] and text[a - 1] in _LOCAL:
                    a -= 1
                if a < start:
                    add(0, a, m.end(), True)
        elif what == "phone":
            if start >= done[3] and (m := _PHONE.match(text, start)):
                add(3, start, m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15)
        elif what == "url":
            a = start
            while a > done[8] and text[a - 1].isascii() and text[a - 1].isalpha():
                a -= 1
            if a < start and (m := _URL.match(text, start)):
                add(8, a, m.end(), True)
        elif what == "address":
            if m := _STREET.search(text, max(done[7], start - 80), start):
                add(7, m.start(), last + 1, True)
        else:
            kind = KINDS.index(what)
            pattern = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[what]
            if start >= done[kind] and (m := pattern.match(text, last + 1)):
                add(kind, m.start(1), m.end(1), what != "iban" or iban_valid(m.group(1)))
    return sorted(out)


def spans(docs: DataFrame) -> DataFrame:
    """All spans of each text: ``doc_id, text_length, kinds, starts, ends`` (arrays, by start).

    A null or empty text has no spans; every row is looked at by itself, so repeated rows give
    repeated results. One Arrow pass without a shuffle, so any text order or skew costs the same.
    """
    def run(batches):
        auto = automaton()
        for b in batches:
            found = [find(t or "", auto) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"),
                pa.array([[k for _, k, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[e for *_, e in f] for f in found], pa.list_(pa.int32()))],
                ["doc_id", "kinds", "starts", "ends"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, kinds array<int>, starts array<int>, ends array<int>")


def op9_pii(spark, folder: str) -> DataFrame:
    """Counts and digests of the spans found by ``find`` in every document."""
    from tessera.llm.common import documents

    def digest(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("kinds", "starts", "ends"))))
            texts = [[f"{KINDS[k]}:{s}:{e}" for k, s, e in zip(*r)] for r in rows]
            base = [",".join(t for t, k in zip(ts, r[0]) if k < 4) for ts, r in zip(texts, rows)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), *[longs([r[0].count(k) for r in rows]) for k in range(4)],
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in base]),
                pa.array([",".join(t) for t in texts])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return spans(documents(spark, folder)).mapInArrow(
        digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                "base_sha256 string, spans string")
