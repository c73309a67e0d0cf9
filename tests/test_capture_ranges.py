"""Capture files in byte ranges give the packets that a walk of the whole file gives."""

import random
import struct

import pytest

from flowsift.sources import pcap, ranges


def _frame(rng, i):
    body = bytes(rng.choices(range(256), k=rng.choice([0, 3, 40, 400, 1400])))
    if rng.random() < 0.1:  # payload that looks like record headers
        body = b"".join(struct.pack("<IIII", 100 + i, 5, 8, 8) + b"\0" * 8 for _ in range(3))
    tcp = struct.pack(">HHIIBBHHH", 1000 + i % 50, 80, i, 8, 5 << 4, 0x12, 512, 0, 0) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    return b"\1" * 6 + b"\2" * 6 + struct.pack(">H", 0x0800) + ip + tcp


def _records(frames, order):
    out = {"<": b"\xd4\xc3\xb2\xa1", ">": b"\xa1\xb2\xc3\xd4"}[order] + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, i % 1000, len(f), len(f)) + f
    return out


def _block(kind, body, order):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def _section(order):
    return _block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def _interface(order, exponent=None, link=1):
    options = b"" if exponent is None else struct.pack(order + "HHB3x", 9, 1, exponent) + struct.pack(order + "HH", 0, 0)
    return _block(1, struct.pack(order + "HHI", link, 0, 65535) + options, order)


def _enhanced(order, number, ts, frame):
    return _block(6, struct.pack(order + "IIIII", number, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)


def _layers(row):
    return row["record"], row["ts_us"], row["length"], row["tcp"]["seq"], bytes(row["payload"])


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("size", [700, 5000, 64 << 20])
def test_record_files_in_ranges(spark, folder, order, size):
    rng = random.Random(size)
    for name, n, tail in (("a", 60, b""), ("b", 25, b"\0" * 9), ("c", 0, b""), ("d", 8, struct.pack(order + "IIII", 1, 1, 99, 99) + b"cut")):
        with open(f"{folder}/{name} x.pcap", "wb") as f:
            f.write(_records([_frame(rng, i) for i in range(n)], order) + tail)
    want = sorted((r["path"], *_layers(r)) for r in pcap.read_captures(spark, folder, None).collect())
    got = sorted((r["path"], *_layers(r)) for r in pcap.read_captures(spark, folder, size).collect())
    assert got == want and len(got) == 93
    if size == 700:
        assert ranges.capture_ranges(spark, folder, size).count() > 40


@pytest.mark.parametrize("size", [600, 4000, 64 << 20])
def test_block_files_in_ranges(spark, folder, size):
    rng = random.Random(1)
    out, want, record = b"", [], 0
    for order, exponent, unit in (("<", None, 1), (">", 9, 1000), ("<", 0x80 | 20, None)):
        out += _section(order) + _interface(order) + _block(5, b"\0" * 12, order) + _interface(order, exponent)
        for i in range(25):
            frame, at = _frame(rng, i), 1_700_000_000_000_000 + i
            number = i % 2
            ticks = at if number == 0 or exponent is None else at * unit if unit else (at << 20) // 1_000_000
            if i == 12:  # an interface in between
                out += _interface(order)
                number, ticks = 2, at
            out += _enhanced(order, number, ticks, frame)
            want.append((record, at if unit or number != 1 else ticks * 1_000_000 >> 20, len(frame), i))
            record += 1
    with open(f"{folder}/x.pcapng", "wb") as f:
        f.write(out)
    got = sorted((r["record"], r["ts_us"], r["length"], r["tcp"]["seq"]) for r in pcap.read_captures(spark, folder, size).collect())
    assert got == want


def test_wrong_guess_is_walked_again(spark, folder, monkeypatch):
    """With a chain of one plausible header the search is often wrong; the result is not."""
    monkeypatch.setattr(ranges, "CHAIN", 1)
    monkeypatch.setattr(ranges.first_record, "__defaults__", (1,))
    rng = random.Random(9)
    frames = [b"".join([_frame(rng, i)[:54], *[struct.pack("<IIII", 7, 7, 8, 8) + b"\1" * 8] * 20]) for i in range(12)]
    with open(f"{folder}/x.pcap", "wb") as f:
        f.write(_records(frames, "<"))
    want = sorted(_layers(r) for r in pcap.read_captures(spark, folder, None).collect())
    assert sorted(_layers(r) for r in pcap.read_captures(spark, folder, 900).collect()) == want and len(want) == 12


def test_what_is_no_capture(spark, folder):
    with open(f"{folder}/x.pcap", "wb") as f:
        f.write(b"no capture file at all, but long enough")
    with pytest.raises(Exception, match="not a packet capture file"):
        pcap.read_captures(spark, folder).count()
