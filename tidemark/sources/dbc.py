"""Message databases: parsing, schemas with multiplexor guards, and the decoding of bus frames in one pass."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..model import Conversion, Field, Schema
from .container import ieee

EXTENDED = 1 << 31


class DatabaseError(ValueError):
    """A statement that can't be read."""


@dataclass(frozen=True)
class Signal:
    name: str
    start: int
    width: int
    big_endian: bool
    signed: bool
    factor: float
    shift: float
    unit: str = ""
    mux: str = ""
    real: int = 0
    labels: tuple[tuple[float, str], ...] = ()
    comment: str = ""

    @property
    def offset(self) -> int:
        """In the container's numbering: a big-endian start names the most significant bit byte-wise from below."""
        return 8 * (self.start // 8) + 7 - self.start % 8 if self.big_endian else self.start


@dataclass(frozen=True)
class Message:
    can_id: int
    extended: bool
    name: str
    size: int
    signals: tuple[Signal, ...] = field(default=())
    comment: str = ""

    @property
    def key(self) -> int:
        return self.can_id | self.extended << 32

    @property
    def multiplexor(self) -> Signal | None:
        return next((s for s in self.signals if s.mux == "M"), None)


TOKEN = re.compile(r"""
    "(?P<text>[^"]*)" | (?P<name>[A-Za-z_]\w*) | (?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?) | (?P<mark>\S)
""", re.X)  # fmt: skip


class Tokens:
    """The tokens of a database: texts, names, numbers and single marks, each with the line that it begins in."""

    def __init__(self, text: str):
        lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.items = [(m.lastgroup, m[m.lastgroup], bisect.bisect_right(lines, m.start())) for m in TOKEN.finditer(text)]
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead][:2] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str, among: str | None = None) -> str:
        found, value = self.peek()
        if found != kind or among is not None and value not in among:
            line = self.items[min(self.at, len(self.items) - 1)][2] if self.items else 0
            raise DatabaseError(f"line {line}: {kind} {among or ''} expected, not {value!r}")
        self.at += 1
        return value

    def until(self, mark: str) -> None:
        while self.peek() not in (("mark", mark), ("end", "")):
            self.at += 1
        self.at += 1


def _message(t: Tokens) -> tuple[int, Message]:
    """BO_ number name : size sender"""
    number, name = int(t.take("number")), t.take("name")
    t.take("mark", ":")
    return number, Message(number & (EXTENDED - 1), bool(number & EXTENDED), name, int(t.take("number")))


def _signal(t: Tokens) -> Signal:
    """SG_ name [M | m number [M]] : start | width @ order sign ( factor , shift ) [ least | most ] unit receivers"""
    name = t.take("name")
    mux = t.take("name") if t.peek()[0] == "name" else ""
    if mux and not re.fullmatch(r"M|m\d+M?", mux):
        raise DatabaseError(f"{name}: {mux} is no multiplexing")
    t.take("mark", ":")
    start = int(t.take("number"))
    t.take("mark", "|")
    width = int(t.take("number"))
    t.take("mark", "@")
    order, sign = t.take("number", "01"), t.take("mark", "+-")
    t.take("mark", "(")
    factor = float(t.take("number"))
    t.take("mark", ",")
    shift = float(t.take("number"))
    t.take("mark", ")")
    t.take("mark", "[")
    t.until("]")
    return Signal(name, start, width, order == "0", sign == "-", factor, shift, t.take("text"), mux)


def parse(text: str) -> list[Message]:
    """Messages in file order. Lookups go by the whole number, its extended bit included, so equal 11- and 29-bit ids differ.

    Messages whose signals are multiplexed by more than one multiplexor (a nested one, or SG_MUL_VAL_) are left out; the others are read.
    """
    found: dict[int, Message] = {}
    refused: set[int] = set()
    now, t = None, Tokens(text)

    def changed(number: int, name: str, **new) -> None:
        if number in found:
            found[number] = replace(found[number], signals=tuple(replace(s, **new) if s.name == name else s for s in found[number].signals))

    while t.peek()[0] != "end":
        keyword, following = t.peek(), t.peek(1)
        t.at += 1
        if keyword == ("name", "BO_") and following[0] == "number":
            now, message = _message(t)
            found[now] = message
        elif keyword == ("name", "SG_") and following[0] == "name" and now is not None:
            signal = _signal(t)
            found[now] = replace(found[now], signals=(*found[now].signals, signal))
            refused |= {now} if signal.mux.startswith("m") and signal.mux.endswith("M") else set()
        elif keyword == ("name", "SG_MUL_VAL_") and following[0] == "number":
            refused.add(int(t.take("number")))
            t.until(";")
        elif keyword == ("name", "VAL_") and following[0] == "number":
            number, name, labels = int(t.take("number")), t.take("name"), []
            while t.peek()[0] == "number":
                labels.append((float(t.take("number")), t.take("text")))
            changed(number, name, labels=tuple(labels))
        elif keyword == ("name", "SIG_VALTYPE_") and following[0] == "number":
            number, name = int(t.take("number")), t.take("name")
            t.at += t.peek() == ("mark", ":")
            changed(number, name, real={"1": 32, "2": 64}.get(t.take("number"), 0))
        elif keyword == ("name", "CM_") and following in (("name", "BO_"), ("name", "SG_")) and t.peek(1)[0] == "number":
            kind, number = t.take("name"), int(t.take("number"))
            name = t.take("name") if kind == "SG_" else None
            comment = t.take("text")
            if name:
                changed(number, name, comment=comment)
            elif number in found:
                found[number] = replace(found[number], comment=comment)
    return [m for number, m in found.items() if number not in refused]


def message_schema(message: Message, database: bytes) -> Schema:
    """A stream per message: label texts win over scaling, multiplexed signals are guarded by the multiplexor."""
    mux = message.multiplexor
    at = [s.name for s in message.signals].index(mux.name) if mux else None
    fields = []
    for s in message.signals:
        if s.labels:
            conversion = Conversion("value_to_text", (s.labels, ""))
        else:
            conversion = Conversion() if (s.factor, s.shift) == (1, 0) else Conversion("linear", (s.shift, s.factor))
        kind = "float" if s.real else "sint" if s.signed else "uint"
        guard = (at, int(s.mux[1:])) if s.mux.startswith("m") and mux else None
        fields.append(Field(s.name, s.offset, s.width, kind, s.big_endian, guard=guard, conversion=conversion, unit=s.unit, desc=s.comment))
    identity = f"{hashlib.sha256(database).hexdigest()}:{message.key}"
    return Schema(str(uuid.uuid5(uuid.NAMESPACE_OID, identity)), message.name, 8 * message.size, tuple(fields), axis_mode="explicit").validate()


def signal_values(message: Message, payload: Column) -> Column:
    """array<struct<signal, value, text>>: null where the guard isn't met or the payload ends before the signal."""
    mux = message.multiplexor
    out = []
    for s in message.signals:
        last = (s.offset + s.width - 1) // 8 + 1
        raw = bits.bit_slice(payload, s.offset, s.width, s.big_endian)
        number = ieee(raw, s.real) if s.real else bits.sign_extend(raw, s.width) if s.signed else bits.unsigned64(raw) if s.width == 64 else raw
        value = F.lit(s.shift) + F.lit(s.factor) * number.cast("double")
        text = F.lit(None).cast("string")
        if s.labels:
            value = number.cast("double")
            for key, label in reversed(s.labels):
                text = F.when(value == key, F.lit(label)).otherwise(text)
        there = F.octet_length(payload) >= last
        if s.mux.startswith("m") and mux:
            there = there & (bits.bit_slice(payload, mux.offset, mux.width, mux.big_endian) == int(s.mux[1:]))
        out.append(F.when(there, F.struct(F.lit(s.name).alias("signal"), value.alias("value"), text.alias("text"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def decode_frames(frames: DataFrame, messages: list[Message]) -> DataFrame:
    """frames (…, can_id, extended, payload): a row per signal present. One scan and no join; unknown messages give no rows."""
    key = bits.can_key(F.col("can_id"), F.col("extended"))
    plan = None
    for m in reversed(messages):
        one = F.struct(F.lit(m.name).alias("message"), signal_values(m, F.col("payload")).alias("signals"))
        plan = F.when(F.col("_key") == F.lit(m.key), one) if plan is None else F.when(F.col("_key") == F.lit(m.key), one).otherwise(plan)
    rest = [c for c in frames.columns if c != "payload"]
    rows = frames.withColumn("_key", key).where(F.col("_key").isin([m.key for m in messages]))
    return rows.select(*rest, plan.alias("m")).select(*rest, "m.message", F.explode("m.signals").alias("s")).select(*rest, "message", "s.signal", "s.value", "s.text")


def unknown_frames(frames: DataFrame, messages: list[Message]) -> DataFrame:
    """Frames per id that no message describes."""
    rows = frames.where(~bits.can_key(F.col("can_id"), F.col("extended")).isin([m.key for m in messages]))
    return rows.groupBy("can_id", "extended").agg(F.count("*").alias("frames"))
