"""TIFF directories and values that overlap are read as the edits before them left the file."""

from __future__ import annotations

import random
import struct

import pytest

from sieveworks.operators import strip
from sieveworks.sources.tree import PRIVATE_TAGS, TYPE_BYTES, Overlay, tiff
from sieveworks.sources.units import Malformed
from tests import media

POINTING = {34665: "ExifIFD", 34853: "GPS", 330: "SubIFD"}


def plainly(data: bytes):
    """(the file, kept, dropped) by one pass over a copy that is changed on the way."""
    file, kept, dropped, thumbs, seen = bytearray(data), [], [], [], set()
    order = "<" if data[:2] == b"II" else ">"
    number = lambda form, at: struct.unpack_from(order + form, file, at)[0]
    chained = 0

    def value(at):
        kind, n = number("H", at + 2), number("I", at + 4)
        size = n * TYPE_BYTES.get(kind, 0)
        place = at + 8 if size <= 4 else number("I", at + 8)
        return (kind, n, place, size) if kind in TYPE_BYTES and place + size <= len(file) else None

    def pointers(at):
        found = value(at)
        if not found or found[0] not in (3, 4, 13) or found[1] > 4096:
            return []
        return [number("H" if found[0] == 3 else "I", found[2] + k * TYPE_BYTES[found[0]]) for k in range(found[1])]

    def zero(at):
        found = value(at)
        if found is None:
            return None
        file[found[2] : found[2] + found[3]] = bytes(found[3])
        return found[3]

    def directory(at, name, depth):
        nonlocal chained
        if at in seen or depth > 16 or at + 2 > len(file):
            return 0
        seen.add(at)
        count = number("H", at)
        if count > 512 or at + 6 + 12 * count > len(file):
            return 0
        kept.append((name, 6 + 12 * count))
        places, sizes, gone = [], [], 0
        for k in range(count):
            e = at + 2 + 12 * k
            tag = number("H", e)
            if name == "GPS":
                gone += zero(e) or 0
            elif tag in POINTING:
                for p in pointers(e)[: None if tag == 330 else 1]:
                    n = directory(p, POINTING[tag], depth + 1)
                    dropped.extend([("GPS", n)] if tag == 34853 else [])
            elif tag == 513:
                places += pointers(e)
            elif tag == 514:
                sizes += pointers(e)
            elif tag in PRIVATE_TAGS and (n := zero(e)) is not None:
                dropped.append((tag, n))
        thumbs.extend((p, p + n) for p, n in zip(places, sizes, strict=False) if p + n <= len(file))
        after = 0 if name == "GPS" else number("I", at + 2 + 12 * count)
        if after and after + 2 <= len(file):
            chained += 1
            directory(after, f"IFD{chained}", depth + 1)
        return gone

    directory(number("I", 4), "IFD0", 0)
    total = 0
    for start, stop in thumbs:
        for at, n in strip.flat.jpeg_metadata(bytes(file), start, stop):
            file[at : at + n] = bytes(n)
            total += n
    return bytes(file), kept, dropped + ([("THMB", total)] if total else [])


def by_reader(data: bytes):
    """The same by the reader's units and the policy of their roles."""
    policy = {role: (action, how) for f, role, action, how in strip.policy_rows() if f == "raw"}
    file, kept, dropped = bytearray(data), [], []
    for unit in tiff(data):
        action, how = policy.get(unit.role, (None, None))
        if action == "keep":
            kept.append((unit.id, unit.size))
        elif action == "drop":
            dropped.append((int(unit.role[3:]) if unit.role.startswith("tag") else unit.id, unit.size))
            for at, n in unit.zones:
                file[at : at + n] = bytes(n)
    return bytes(file), kept, dropped


def tangled(seed: int) -> bytes:
    """A small file whose directories and values lie anywhere, on each other too."""
    rng = random.Random(seed)
    size, order = rng.choice((200, 400, 800)), rng.choice("<>")
    file = bytearray(rng.choice((0, 0, 1, 2, 255)) for _ in range(size))
    at = rng.randrange(8, 20)
    file[:8] = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", at)
    tags = (270, 315, 700, 271, 34665, 34853, 34853, 330, 330, 513, 514, 40965, 37500)
    places = [at, *(rng.randrange(8, size - 8) for _ in range(5))]
    for place in places:
        count = rng.randrange(1, 5)
        for k in range(count):
            tag = rng.choice(tags)
            if tag in POINTING and rng.random() < 0.8:
                e = (tag, 4, 1, rng.choice(places))
            else:
                e = (tag, rng.choice((1, 2, 2, 3, 4, 5, 13, 99)), rng.choice((1, 2, 3, 9, 20, 40)), max(0, rng.choice(places) - rng.randrange(-8, 8)))
            file[place + 2 + 12 * k : place + 14 + 12 * k] = struct.pack(f"{order}HHII", *e)
        file[place : place + 2] = struct.pack(f"{order}H", count)
        file[place + 2 + 12 * count : place + 6 + 12 * count] = struct.pack(f"{order}I", rng.choice((0, rng.randrange(size))))
    return bytes(file[:size])


def test_tangled_files_equal_one_pass_over_a_changing_copy():
    met = differ = 0
    for seed in range(6000):
        data = tangled(seed)
        try:
            want = plainly(data)
        except struct.error:
            continue
        assert by_reader(data) == want, seed
        met += 1
        frozen = [u for u in tiff(data, now=Untouched(data))]
        differ += [u[:3] for u in frozen] != [u[:3] for u in tiff(data)]
    assert met > 5000 and differ > 200  # the edits matter in many of them


class Untouched(Overlay):
    """What reading the input alone would see."""

    def clear(self, at: int, n: int) -> None:
        pass


def test_camera_file_equals_one_pass():
    for order in "<>":
        assert by_reader(media.camera_raw(order)) == plainly(media.camera_raw(order))


def test_overlay_reads_as_a_changed_copy():
    rng = random.Random(7)
    data = bytes(rng.randrange(1, 256) for _ in range(300))
    for _ in range(200):
        now, copy = Overlay(data), bytearray(data)
        for _ in range(rng.randrange(12)):
            at, n = rng.randrange(300), rng.randrange(40)
            n = min(n, 300 - at)
            now.clear(at, n)
            copy[at : at + n] = bytes(n)
        assert now.starts == sorted(now.starts) and all(a < b for a, b in zip(now.stops, now.starts[1:], strict=False))
        for _ in range(20):
            at, n = rng.randrange(300), rng.randrange(60)
            assert now.read(at, n) == copy[at : at + n]


def test_a_cleared_header_is_no_tiff():
    data = media.camera_raw()
    now = Overlay(data)
    now.clear(0, 2)
    with pytest.raises(Malformed):
        list(tiff(data, now=now))
