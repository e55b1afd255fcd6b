"""Compressed payloads: the device's packet framing rewritten as a CAF file, and a decoder if one is installed."""

from __future__ import annotations

import io
import os
import shutil
import struct
import subprocess
import tempfile
import wave
from collections.abc import Callable

import numpy as np

from tidewater.sources.containers import HEADER, MAGIC

# The codec's parameters as the CAF container states them.
FRAMES_PER_PACKET, RATE = 128, 11162.0
COOKIE = struct.pack(">IBBBBBBHIII", FRAMES_PER_PACKET, 0, 16, 40, 10, 14, 1, 255, 0, 0, int(RATE))


def variable_length(raw: bytes, most: int = 5) -> tuple[int, int]:
    """(value, bytes used) of a big-endian number of seven bits a byte."""
    value = 0
    for used, b in enumerate(raw[:most], 1):
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            return value, used
    return value, min(len(raw), most)


def packets(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(entry of the packet table, data) of each whole packet: two bytes of length, one that tells the entry's size."""
    at, out = HEADER.size if payload[:4] == MAGIC else 0, []
    while at + 3 <= len(payload):
        head = payload[at : at + 3]
        size, _ = variable_length(head, 2)
        data = payload[at + 3 : at + 3 + size]
        if len(data) < size:
            break
        out.append((head[: head[2]], data))
        at += 3 + size
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack(">Q", len(body)) + body


def to_caf(payload: bytes) -> bytes:
    """A CAF file of the packets; its table holds exactly as many entries as there are packets."""
    found = packets(payload)
    table = struct.pack(">QQII", len(found), len(found) * FRAMES_PER_PACKET, 0, 0) + b"".join(e for e, _ in found)
    describe = struct.pack(">d4sIIIII", RATE, b"alac", 1, 0, FRAMES_PER_PACKET, 1, 0)
    return b"caff\0\1\0\0" + _chunk(b"desc", describe) + _chunk(b"kuki", COOKIE) + _chunk(b"pakt", table) + _chunk(b"data", b"\0\0\0\1" + b"".join(d for _, d in found))


def find_tool(path: str | None = None) -> str | None:
    """The converter: as given, as FFMPEG_PATH says, or on the path."""
    for p in (path, os.environ.get("FFMPEG_PATH"), shutil.which("ffmpeg")):
        if p and os.access(p, os.X_OK):
            return p
    return None


def tool_decoder(path: str | None = None) -> Callable[[bytes], np.ndarray]:
    """A decoder that runs the converter on each payload; raises ValueError where there is none."""

    def run(payload: bytes) -> np.ndarray:
        tool = find_tool(path)
        if tool is None:
            raise ValueError("no converter is installed")
        with tempfile.NamedTemporaryFile(suffix=".caf") as f:
            f.write(to_caf(payload))
            f.flush()
            made = subprocess.run([tool, "-v", "error", "-i", f.name, "-f", "wav", "-acodec", "pcm_s16le", "-"], capture_output=True, check=False)
        if made.returncode:
            raise ValueError(made.stderr.decode(errors="replace")[-300:])
        with wave.open(io.BytesIO(made.stdout)) as w:
            if w.getsampwidth() != 2:
                raise ValueError("samples are not of 16 bits")
            return np.frombuffer(w.readframes(w.getnframes()), "<i2")

    return run
