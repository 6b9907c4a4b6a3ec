"""Audio file headers and PCM, from bytes."""

from __future__ import annotations

import re
import struct

import numpy as np

NONE = {"container": None, "codec": None, "rate": None, "bits": None, "channels": None, "seconds": None, "tags": {}}
# Signatures that programs leave in files: kind, what it tells, pattern; (?i) where case doesn't count
CLUES = [
    ("yt", "YouTube URL embedded in the tags", r"(?i)(?:youtube\.com/watch\?v=|youtu\.be/|music\.youtube\.com)[\w\-=?&]{4,}"),
    ("yt", "Downloaded with yt-dlp / youtube-dl", r"(?i)yt-dlp|youtube-dl"),
    ("yt", "Google video-file muxer (YouTube)", r"(?i)google/video-file"),
    ("yt", "Video downloader / converter", r"(?i)4K Video Downloader|ClipGrab|MediaHuman|Freemake|Any Video Converter|y2mate|ytmp3|savefrom|onlinevideoconverter"),
    ("stream", "SoundCloud", r"soundcloud\.com|SoundCloud"),
    ("stream", "Stream recorder / downloader", r"Audials|Streamripper|Deezloader|deemix|spotdl|SpotDL|Soundiiz"),
    ("store", "Store or streaming service", r"Qobuz|HDtracks|7digital|TIDAL|Tidal|Deezer|Beatport|Bandcamp|bandcamp\.com|Spotify|Amazon Music"),
    ("mp3", "LAME MP3 encoder", r"LAME ?3\.\d{2,3}|LAME3\.\d+|Lame 3\.\d+"),
    ("mp3", "Fraunhofer MP3/AAC encoder", r"Fraunhofer|FhG IIS"),
    ("lossy", "libVorbis encoder", r"Xiph\.Org libVorbis|libvorbis"),
    ("lossy", "libopus encoder", r"libopus \d"),
    ("lossy", "Nero AAC encoder", r"Nero AAC|Nero Digital"),
    ("ffmpeg", "FFmpeg muxer (libavformat)", r"Lavf\d+\.\d+\.\d+"),
    ("ffmpeg", "FFmpeg encoder (libavcodec)", r"Lavc\d+\.\d+\.\d+"),
    ("apple", "iTunes / Apple Music", r"iTunes \d|iTunNORM|Apple Music"),
    ("rip", "Exact Audio Copy (CD ripper)", r"Exact Audio Copy|EAC V\d"),
    ("rip", "XLD (CD ripper)", r"X Lossless Decoder|XLD \d"),
    ("rip", "CD ripper", r"CUERipper|CUETools|whipper|morituri|Rubyripper|cdparanoia"),
    ("rip", "dBpoweramp (ripper / converter)", r"dBpoweramp"),
    ("tool", "foobar2000", r"(?i)foobar2000"),
    ("tool", "Audacity", r"Audacity"),
    ("tool", "SoX resampler", r"\bSoX\b|libsoxr"),
    ("tool", "Mastering / resampling software", r"Adobe Audition|iZotope|Sonic Studio|Saracon|Weiss"),
    ("flac", "libFLAC encoder", r"reference libFLAC [\d.]+"),
]
DASH = ("yt", "MP4 “dash” brand: DASH audio as YouTube streams it")
WEBM = ("web", "WebM container, the way YouTube serves Opus")
_RULES = [(kind, told, re.compile(rx, re.ASCII)) for kind, told, rx in CLUES]


def _brands(b: bytes) -> list[bytes]:
    """The major and compatible brands of an MP4 file."""
    if b[4:8] != b"ftyp":
        return []
    box = b[8 : min(len(b), int.from_bytes(b[:4], "big"))]
    return [box[:4], *(box[i : i + 4] for i in range(8, len(box) - 3, 4))]


def clues(b: bytes, said: dict | None = None, head: int = 1 << 20, tail: int = 1 << 18) -> list[dict]:
    """Signatures in a file's first MB, last quarter MB and the texts of its header: kind, label, match (printable,
    70 characters at most), the first match of each, in the table's order."""
    said = said or header(b)
    ends = b[:head] + b"\n" + b[max(head, len(b) - tail) :]
    text = "\n".join([ends.decode("latin-1"), *map(str, said["tags"].values())])
    hits = ((kind, told, rx.search(text)) for kind, told, rx in _RULES)
    found = [(kind, told, "".join(x for x in m[0] if " " <= x <= "~")[:70]) for kind, told, m in hits if m]
    if b"dash" in _brands(b):
        found.append((*DASH, "ftyp dash"))
    if said["container"] == "WebM":
        found.append((*WEBM, f"WebM / {said['codec']}"))
    return [dict(zip(("kind", "label", "match"), x, strict=True)) for x in found]


def _chunks(b: bytes, p: int, order: str):
    while p + 8 <= len(b):
        n = struct.unpack_from(order + "I", b, p + 4)[0]
        yield b[p : p + 4], p + 8, n
        p += 8 + n + (n & 1)


def _wav(b: bytes) -> dict:
    out, rate = NONE | {"container": "WAV"}, 0
    for tag, p, n in _chunks(b, 12, "<"):
        if tag == b"fmt " and n >= 16:
            form, ch, sr, rate, _, bits = struct.unpack_from("<HHIIHH", b, p)
            form = struct.unpack_from("<H", b, p + 24)[0] if form == 0xFFFE and n >= 26 else form
            out |= {"codec": {1: "PCM", 3: "float"}.get(form, f"0x{form:04x}"), "rate": sr, "bits": bits, "channels": ch}
        elif tag == b"data" and rate:
            out["seconds"] = min(n, len(b) - p) / rate
    return out


def _extended(b: bytes) -> float:
    e, m = struct.unpack(">HQ", b)
    return m * 2.0 ** ((e & 0x7FFF) - 16446)


def _aiff(b: bytes) -> dict:
    out = NONE | {"container": "AIFF"}
    for tag, p, n in _chunks(b, 12, ">"):
        if tag == b"COMM" and n >= 18:
            ch, frames, bits = struct.unpack_from(">HIH", b, p)
            rate = _extended(b[p + 8 : p + 18])
            kind = b[p + 18 : p + 22] if b[8:12] == b"AIFC" else b"NONE"
            out |= {"codec": {b"NONE": "PCM", b"sowt": "PCM", b"fl32": "float", b"FL32": "float"}.get(kind, kind.decode("latin-1")), "rate": int(rate), "bits": bits, "channels": ch, "seconds": frames / rate if rate else None}
    return out


def _comments(b: bytes) -> dict:
    try:
        p = 4 + struct.unpack_from("<I", b)[0]
        n, p, out = struct.unpack_from("<I", b, p)[0], p + 4, {}
        for _ in range(n):
            size = struct.unpack_from("<I", b, p)[0]
            k, _, v = b[p + 4 : p + 4 + size].decode("utf-8", "replace").partition("=")
            out.setdefault(k.lower(), v)
            p += 4 + size
        return out
    except struct.error:
        return {}


def _flac(b: bytes) -> dict:
    out, p, last = NONE | {"container": "FLAC", "codec": "FLAC"}, 4, False
    while not last and p + 4 <= len(b):
        last, kind, n = bool(b[p] & 128), b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        d = b[p + 4 : p + 4 + n]
        if kind == 0 and len(d) >= 18:
            x = int.from_bytes(d[10:18], "big")
            rate, total = x >> 44, x & ((1 << 36) - 1)
            out |= {"rate": rate, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "seconds": total / rate if rate else None}
        elif kind == 4:
            out["tags"] = _comments(d)
        p += 4 + n
    return out


def _id3(b: bytes) -> tuple[dict, int]:
    if b[:3] != b"ID3" or len(b) < 10:
        return {}, 0
    size = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    end, p, out = 10 + size(b[6:10]), 10, {}
    while p + 10 <= min(end, len(b)) and b[p]:
        n = size(b[p + 4 : p + 8]) if b[3] >= 4 else int.from_bytes(b[p + 4 : p + 8], "big")
        tag, d = b[p : p + 4].decode("latin-1"), b[p + 10 : p + 10 + n]
        if tag[0] == "T" and d:
            out.setdefault(tag.lower(), d[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[d[0] & 3], "replace").split("\0")[0])
        p += 10 + n
    return out, end


def _mp3(b: bytes) -> dict:
    tags, p = _id3(b)
    out = NONE | {"container": "MP3", "tags": tags}
    for p in range(p, max(p, min(len(b) - 4, p + 8192))):
        h = int.from_bytes(b[p : p + 4], "big")
        version, layer, kbps, rate = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
        if h >> 21 != 0x7FF or version == 1 or kbps in (0, 15) or rate == 3:
            continue
        hz = [44100, 48000, 32000][rate] >> {3: 0, 2: 1, 0: 2}[version]
        if layer == 0:
            return out | {"container": "ADTS", "codec": "AAC", "rate": hz}
        step = ([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320] if version == 3 else [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160])[kbps - 1]
        return out | {"codec": f"MPEG layer {4 - layer}", "rate": hz, "channels": 1 if h >> 6 & 3 == 3 else 2, "seconds": (len(b) - p) * 8 / (step * 1000)}
    return out


def _adts(b: bytes) -> dict:
    rates = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
    i = b[2] >> 2 & 15
    return NONE | {"container": "ADTS", "codec": "AAC", "rate": rates[i] if i < len(rates) else None, "channels": (b[2] & 1) << 2 | b[3] >> 6}


def _ogg(b: bytes) -> dict:
    out = NONE | {"container": "Ogg"}
    if (i := b.find(b"\x01vorbis")) >= 0 and i + 16 <= len(b):
        out |= {"codec": "Vorbis", "channels": b[i + 11], "rate": struct.unpack_from("<I", b, i + 12)[0]}
        if (c := b.find(b"\x03vorbis")) >= 0:
            out["tags"] = _comments(b[c + 7 :])
    elif (i := b.find(b"OpusHead")) >= 0 and i + 10 <= len(b):
        out |= {"codec": "Opus", "channels": b[i + 9], "rate": 48000}
        if (c := b.find(b"OpusTags")) >= 0:
            out["tags"] = _comments(b[c + 8 :])
    if (last := b.rfind(b"OggS")) >= 0 and last + 14 <= len(b) and out["rate"]:
        out["seconds"] = struct.unpack_from("<q", b, last + 6)[0] / out["rate"]
    return out


def _mp4(b: bytes) -> dict:
    out = NONE | {"container": "MP4"}

    def walk(p: int, end: int):
        while p + 8 <= end:
            n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
            n = end - p if n == 0 else n
            if n < 8:
                return
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                walk(p + 8, min(end, p + n))
            elif kind == b"mdhd" and p + 32 <= end:
                scale, length = struct.unpack_from(">II", b, p + 20) if b[p + 8] == 0 else struct.unpack_from(">IQ", b, p + 28)
                out["seconds"] = length / scale if scale else None
            elif kind == b"stsd" and p + 52 <= end:
                ch, bits, rate = struct.unpack_from(">HH4xH", b, p + 40)
                out.update(codec={b"mp4a": "AAC", b"alac": "ALAC", b"fLaC": "FLAC", b"Opus": "Opus"}.get(b[p + 20 : p + 24], b[p + 20 : p + 24].decode("latin-1")), channels=ch, bits=bits, rate=rate)
            p += n

    walk(0, len(b))
    return out


def header(b: bytes) -> dict:
    """What a file says of itself; nulls where it doesn't, or is cut short."""
    try:
        if b[:4] in (b"RIFF", b"RF64") and b[8:12] == b"WAVE":
            return _wav(b)
        if b[:4] == b"FORM" and b[8:12] in (b"AIFF", b"AIFC"):
            return _aiff(b)
        if b[:4] == b"fLaC":
            return _flac(b)
        if b[:4] == b"OggS":
            return _ogg(b)
        if b[4:8] == b"ftyp":
            return _mp4(b)
        if b[:4] == b"\x1aE\xdf\xa3":
            return NONE | {"container": "WebM", "codec": "Opus" if b"A_OPUS" in b[:4096] else "Vorbis" if b"A_VORBIS" in b[:4096] else None}
        if len(b) > 4 and b[0] == 0xFF and b[1] & 0xF6 == 0xF0:
            return _adts(b)
        if b[:3] == b"ID3" or len(b) > 4 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0:
            return _mp3(b)
    except (struct.error, IndexError):
        pass
    return dict(NONE)


def pcm(b: bytes) -> np.ndarray:
    """Samples of a WAV file, frames by channels, -1 to 1; empty unless 8 to 32 bit PCM or float."""
    h = _wav(b) if b[:4] == b"RIFF" else NONE
    if h["codec"] not in ("PCM", "float") or not h["channels"]:
        return np.zeros((0, 1))
    raw = next((b[p : p + n] for tag, p, n in _chunks(b, 12, "<") if tag == b"data"), b"")
    width = h["bits"] // 8
    raw = raw[: len(raw) // (width * h["channels"]) * width * h["channels"]]
    if h["codec"] == "float":
        x = np.frombuffer(raw, f"<f{width}").astype(float)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, width)
        wide = np.zeros((len(parts), 4), np.uint8)
        wide[:, 4 - width :] = parts
        x = wide.view("<i4").ravel() / 2.0**31
    return x.reshape(-1, h["channels"])
