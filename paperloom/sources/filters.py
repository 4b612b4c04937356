"""Stream filters of document files: ASCIIHex, ASCII85, RunLength, LZW, Flate and their predictors."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What one stream may unfold to.
MAX_BYTES = 64 << 20
_SPACE = b"\0\t\n\f\r "


class FilterError(ValueError):
    """Data that its filter cannot read."""


def ascii_hex(data: bytes, strict: bool = True) -> bytes:
    body = data.split(b">", 1)[0].translate(None, _SPACE)
    bad = [c for c in body if c not in b"0123456789abcdefABCDEF"]
    if bad and strict:
        raise FilterError("not a hexadecimal digit")
    body = bytes(c for c in body if c in b"0123456789abcdefABCDEF") if bad else body
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii85(data: bytes, strict: bool = True) -> bytes:
    body = data.split(b"~", 1)[0].translate(None, _SPACE)
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for d in group:
                    n = n * 85 + d
                if n >> 32:
                    if strict:
                        raise FilterError("a group is too large")
                    n &= 0xFFFFFFFF
                out += n.to_bytes(4, "big")
                group = []
        elif strict:
            raise FilterError("not an ASCII85 character")
    if len(group) == 1 and strict:
        raise FilterError("a group is cut off")
    if len(group) > 1:
        n = 0
        for d in group + [84] * (5 - len(group)):
            n = n * 85 + d
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(data: bytes, strict: bool = True) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            if i + 2 + n > len(data) and strict:
                raise FilterError("a run is cut off")
            i += n + 2
        else:
            if i + 1 >= len(data):
                if strict:
                    raise FilterError("a run is cut off")
                break
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def lzw(data: bytes, strict: bool = True, early: int = 1) -> bytes:
    """Variable codes of 9 to 12 bits; 256 clears the table, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, before = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, before = 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            elif strict:
                raise FilterError("a code is not in the table")
            else:
                return bytes(out)
            out += entry
            if len(out) > MAX_BYTES:
                raise FilterError("the stream is too large")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def flate(data: bytes, strict: bool = True) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, MAX_BYTES)
        if d.unconsumed_tail:
            raise FilterError("the stream is too large")
        if strict and not d.eof:
            raise FilterError("the stream is cut off")
        return out
    except zlib.error as e:
        if strict:
            raise FilterError(str(e)) from None
    d, out = zlib.decompressobj(), bytearray()
    for i in range(len(data)):
        try:
            out += d.decompress(data[i : i + 1])
        except zlib.error:
            break
    return bytes(out)


def predict(data: bytes, predictor: int = 1, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes predictor 2 (differences across a row) or 10 and over (one filter byte a row)."""
    if predictor == 1:
        return data
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out = bytearray()
    if predictor == 2:
        if bits != 8:
            raise FilterError("only 8 bits a component are supported here")
        for at in range(0, len(data), row):
            line = bytearray(data[at : at + row])
            for i in range(step, len(line)):
                line[i] = (line[i] + line[i - step]) & 255
            out += line
        return bytes(out)
    above = bytes(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - step] if i >= step else 0
            up, corner = above[i], above[i - step] if i >= step else 0
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                p = left + up - corner
                guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                guess = 0
            line[i] = (line[i] + guess) & 255
        out += line
        above = bytes(line).ljust(row, b"\0")
    return bytes(out)


FILTERS = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "LZWDecode": lzw, "FlateDecode": flate}
FILTERS |= {"AHx": ascii_hex, "A85": ascii85, "RL": run_length, "LZW": lzw, "Fl": flate}


def decode(data: bytes, names: list[str], params: list[dict] | None = None, strict: bool = True) -> bytes:
    """A chain of filters; ``params`` has a predictor's settings for each."""
    for i, name in enumerate(names):
        if name not in FILTERS:
            raise FilterError(f"no filter {name}")
        data = FILTERS[name](data, strict)
        p = (params or [])[i] if params and i < len(params) else None
        if p:
            data = predict(data, p.get("Predictor", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
    return data


def decoded(raw: Column, names: Column) -> Column:
    """A column of streams through its column of filter names, tolerant; null where a filter cannot go on."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, chain: pd.Series) -> pd.Series:
        def one(d, n):
            try:
                return None if d is None else decode(bytes(d), list(n) if n is not None else [], strict=False)
            except FilterError:
                return None

        return pd.Series([one(d, n) for d, n in zip(data, chain, strict=True)])

    return run(raw, names)
