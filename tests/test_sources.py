"""Importers on small files written here, and their Spark readers."""

import plistlib
import sqlite3
import struct
import wave
import zlib

import pytest

from catalune.sources import audio, importers, libraries

REKORDBOX = b"""<?xml version="1.0"?><DJ_PLAYLISTS Version="1.0.0"><COLLECTION>
<TRACK TrackID="7" Name="N" Artist="A" TotalTime="200" AverageBpm="128.00" Rating="204" Year="0" Location="file://localhost/C:/m/a%20b.mp3">
<TEMPO Inizio="0.5" Bpm="120" Battito="2"/><POSITION_MARK Type="4" Start="9" End="11" Num="1"/><POSITION_MARK Type="0" Start="3" Num="-1" Red="255" Green="0" Blue="16"/></TRACK>
<TRACK TrackID="8" Name="no place"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="F"><NODE Type="1" Name="P" KeyType="0"><TRACK Key="7"/></NODE><NODE Type="1" Name="P" KeyType="1"><TRACK Key="file://localhost/C:/m/a%20b.mp3"/><TRACK Key="x"/></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""
TRAKTOR = b"""<NML VERSION="19"><COLLECTION><ENTRY TITLE="T" ARTIST="A"><LOCATION DIR="/:Users/:x/:" FILE="a.mp3" VOLUME="Ext"/><INFO GENRE="G" RANKING="153" PLAYTIME="100" FILESIZE="10" IMPORT_DATE="2024/1/2"/><TEMPO BPM="100"/><MUSICAL_KEY VALUE="21"/><CUE_V2 TYPE="4" START="600"/><CUE_V2 TYPE="5" START="2000" LEN="500" HOTCUE="2" NAME="n.n."/></ENTRY>
<ENTRY TITLE="own"><LOCATION DIR="/:Native Instruments/:x/:" FILE="b.wav" VOLUME="C:"/></ENTRY></COLLECTION>
<PLAYLISTS><NODE TYPE="FOLDER" NAME="$ROOT"><SUBNODES><NODE TYPE="PLAYLIST" NAME="L"><PLAYLIST UUID="u1"><ENTRY><PRIMARYKEY KEY="Ext/:Users/:x/:a.mp3"/></ENTRY></PLAYLIST></NODE></SUBNODES></NODE></PLAYLISTS></NML>"""


def _tlv(tag, data):
    return tag.encode() + struct.pack(">I", len(data)) + data


def _u(s):
    return s.encode("utf-16-be")


SERATO = _tlv("vrsn", _u("2.0")) + _tlv("otrk", _tlv("pfil", _u("Music/a.mp3")) + _tlv("tsng", _u("Song")) + _tlv("tlen", _u("03:45.50")) + _tlv("uadd", struct.pack(">I", 86400)) + _tlv("tsiz", _u("5.5MB")))
CRATE = _tlv("vrsn", _u("1.0")) + _tlv("otrk", _tlv("ptrk", _u("Music/a.mp3")))


def _engine(uuid="u"):
    con = sqlite3.connect(":memory:")
    con.executescript("""CREATE TABLE Information (uuid TEXT); CREATE TABLE Track (id INTEGER, path TEXT, title TEXT, rating INTEGER, bpm REAL, key INTEGER);
      CREATE TABLE Playlist (id INTEGER, title TEXT, parentListId INTEGER, nextListId INTEGER); CREATE TABLE PlaylistEntity (id INTEGER, listId INTEGER, trackId INTEGER, nextEntityId INTEGER, databaseUuid TEXT);
      CREATE TABLE PerformanceData (trackId INTEGER, quickCues BLOB, loops BLOB, beatData BLOB);
      INSERT INTO Track VALUES (1, '..\\m\\a.mp3', 'A', 80, 124, 5), (2, NULL, 'none', 0, 0, NULL); INSERT INTO Playlist VALUES (1, 'second', 0, 0), (2, 'first', 0, 1);
      INSERT INTO PlaylistEntity VALUES (1, 1, 1, 0, NULL), (2, 1, 9, 1, NULL), (3, 1, 4, 2, 'other');""")
    con.execute("INSERT INTO Information VALUES (?)", (uuid,))
    q = lambda b: struct.pack(">I", len(b)) + zlib.compress(b)
    quick = struct.pack(">q", 1) + b"\x02Hi" + struct.pack(">d", 44100.0) + bytes([255, 1, 2, 3]) + struct.pack(">dB", 0.0, 0)
    marks = struct.pack(">q", 2) + struct.pack("<dqq", 22050.0, 0, 0) + struct.pack("<dqq", 44100.0, 1, 0)
    loops = struct.pack("<q", 1) + b"\x00" + struct.pack("<ddBB", 88200.0, 132300.0, 1, 1) + bytes(4)
    con.execute("INSERT INTO PerformanceData VALUES (1, ?, ?, ?)", (q(quick), loops, q(struct.pack(">ddB", 44100.0, 1e6, 1) + marks + struct.pack(">q", 0))))
    con.commit()
    return con.serialize()


APPLE = plistlib.dumps({"Tracks": {"5": {"Location": "file:///m/a.mp3", "Name": "N", "Rating": 80, "Total Time": 1500, "Date Added": __import__("datetime").datetime(2024, 1, 2)}, "6": {"Location": "http://x", "Track Type": "URL"}}, "Playlists": [{"Name": "Library", "Master": True}, {"Name": "P", "Playlist Persistent ID": "X", "Parent Persistent ID": "gone", "Playlist Items": [{"Track ID": 5}, {"Track ID": 6}]}]})
M3U = "\ufeff#EXTM3U\n#EXTINF:61,Who - What\nC:\\m\\a.mp3\n\n# x\nfile:///m/b%20c.mp3\n".encode()


def test_rekordbox():
    (t,), lists = importers.rekordbox(REKORDBOX)
    assert (t["path"], t["year"], t["rating"], t["duration"]) == ("C:/m/a b.mp3", "", 4.0, 200.0)
    assert [(c["t"], c["kind"], c["num"], c["color"], c["end"]) for c in t["cues"]] == [(3.0, "cue", None, "#ff0010", None), (9.0, "loop", 1, None, 11.0)]
    assert t["grid"] == {"bpm": 120.0, "beat0": 0.0, "bar": 0}
    assert [(x["id"], x["items"]) for x in lists] == [("/F", []), ("/F/P", ["7"]), ("/F/P#2", ["7"])]


def test_traktor():
    (t,), (pl,) = importers.traktor(TRAKTOR)
    assert (t["path"], t["key"], t["size"], t["rating"], t["added"]) == ("/Volumes/Ext/Users/x/a.mp3", "Am", 10240.0, 3.0, "2024-1-2")
    assert t["grid"]["bar"] == 1 and t["grid"]["beat0"] == pytest.approx(0, abs=1e-9) and t["cues"][0]["end"] == 2.5 and t["cues"][0]["name"] == ""
    assert (pl["id"], pl["items"]) == ("u:u1", ["Ext/:Users/:x/:a.mp3"])


def test_apple():
    (t,), (pl,) = importers.apple(APPLE)
    assert (t["path"], t["rating"], t["duration"], t["added"]) == ("/m/a.mp3", 4.0, 1.5, "2024-01-02")
    assert (pl["parent"], pl["items"]) == (None, ["5"])


def test_serato():
    (t,), _ = importers.serato(SERATO)
    assert (t["id"], t["path"], t["duration"], t["added"], t["size"]) == ("/music/a.mp3", "/Music/a.mp3", 225.5, "1970-01-02", 5.5)
    _, lists = importers.serato(CRATE, "A%%B.crate")
    assert [(x["id"], x["parent"], x["items"]) for x in lists] == [("f:A", None, []), ("c:A%%B.crate", "f:A", ["/music/a.mp3"])]
    assert importers.tlv(SERATO[:-3])[0][0] == "vrsn"


def test_engine():
    (t,), lists = importers.engine(_engine())
    assert (t["id"], t["path"], t["rating"], t["bpm"]) == ("u/1", "../m/a.mp3", 4.0, 124.0)
    assert [(c["t"], c["kind"], c["name"], c["color"], c["end"]) for c in t["cues"]] == [(1.0, "cue", "Hi", "#010203", None), (2.0, "loop", "", None, 3.0)]
    assert t["grid"] == {"bpm": 120.0, "beat0": 0.0, "bar": 1}
    assert [(x["name"], x["items"]) for x in lists] == [("first", []), ("second", ["other/4", "u/9", "u/1"])]


def test_m3u():
    t, (pl,) = importers.m3u(M3U, "x/My.m3u8")
    assert [(x["path"], x["artist"], x["title"], x["duration"]) for x in t] == [("C:/m/a.mp3", "Who", "What", 61.0), ("/m/b c.mp3", "", "", None)]
    assert pl["name"] == "My" and pl["items"] == ["c:/m/a.mp3", "/m/b c.mp3"]


def test_libraries_reader(spark, tmp_path):
    for name, data in {"a.xml": REKORDBOX, "b.nml": TRAKTOR, "c.xml": APPLE, "database V2": SERATO, "A.crate": CRATE, "m.db": _engine(), "l.m3u8": M3U, "bad.xml": b"<NML>", "notes.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(data)
    libs = libraries.libraries(spark, str(tmp_path)).cache()
    got = {r["file"].rsplit("/", 1)[-1]: (r["app"], len(r["tracks"]), r["error"] is None) for r in libs.collect()}
    assert got["a.xml"] == ("rekordbox", 1, True) and got["m.db"] == ("engine", 1, True) and got["bad.xml"][2] is False and got["notes.txt"][:2] == (None, 0) and len(got) == 9
    assert libraries.imported_tracks(libs).count() == 7
    entries, counts = libraries.combined(libs)
    c = {r["file"].rsplit("/", 1)[-1]: r for r in counts.collect()}["m.db"]
    assert (c["entries"], c["matched"], c["other"], c["gone"]) == (3, 1, 1, 1) and entries.where("item = 'u/1'").count() == 1


def test_headers(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", None))
        w.writeframes(struct.pack("<4h", 16384, -16384, 0, 32767))
    info = (8000 << 44 | 1 << 41 | 15 << 36 | 16000).to_bytes(8, "big")
    note = struct.pack("<I", 3) + b"enc" + struct.pack("<I", 1) + struct.pack("<I", 7) + b"TITLE=x"
    (tmp_path / "y.flac").write_bytes(b"fLaC" + b"\0" + (34).to_bytes(3, "big") + bytes(10) + info + bytes(16) + b"\x84" + len(note).to_bytes(3, "big") + note + b"reference libFLAC 1.3.2")
    (tmp_path / "z.mp3").write_bytes(b"ID3\x03\0\0\0\0\0\x0f" + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0\0Song" + b"\xff\xfb\x90\x00" + bytes(412))
    (tmp_path / "cut.flac").write_bytes(b"fLaC\0")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in libraries.audio_headers(spark, str(tmp_path)).collect()}
    assert (got["x.wav"]["codec"], got["x.wav"]["rate"], got["x.wav"]["seconds"]) == ("PCM", 8000, 2 / 8000)
    assert (got["y.flac"]["bits"], got["y.flac"]["channels"], got["y.flac"]["seconds"], got["y.flac"]["tags"], [tuple(c) for c in got["y.flac"]["clues"]]) == (16, 2, 2.0, {"title": "x"}, [("flac", "libFLAC encoder", "reference libFLAC 1.3.2")])
    assert (got["z.mp3"]["codec"], got["z.mp3"]["rate"], got["z.mp3"]["tags"]) == ("MPEG layer 3", 44100, {"tit2": "Song"})
    assert got["cut.flac"]["rate"] is None
    assert audio.pcm((tmp_path / "x.wav").read_bytes()).tolist() == [[0.5, -0.5], [0.0, 32767 / 32768]]
    assert {r["file_name"] for r in libraries.scan(spark, str(tmp_path)).collect()} == {"x.wav", "y.flac", "z.mp3", "cut.flac"}


def test_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ab.json").write_text('{"ab1": {"title": "x", "n": 1}, "ab2": {"title": null}}')
    (tmp_path / "in" / "cd.json").write_text('{"cd1": {"titl')
    good, bad = libraries.load_shards(spark, str(tmp_path / "in"), "title string, n int")
    assert sorted((r["id"], r["title"], r["n"]) for r in good.collect()) == [("ab1", "x", 1), ("ab2", None, None)] and bad.count() == 1
    out = str(tmp_path / "out")
    libraries.flush(good.unionByName(spark.createDataFrame([("zz1", "z", 2)], good.schema)), out)
    libraries.flush(spark.createDataFrame([("zz2", "new", 3)], good.schema), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["ab1", "ab2", "zz2"]
    assert libraries.snapshots_kept([f"2024-01-{d:02d}{x}" for d in range(1, 31) for x in ("a", "b")])[0] == "2024-01-17b"


def test_clues():
    found = lambda b: [(c["kind"], c["match"]) for c in audio.clues(b)]
    assert found(b"xx Lavf58.29.100 yy Lavc58.54.100 SOUNDCLOUD.COM SoundCloud") == [("stream", "SoundCloud"), ("ffmpeg", "Lavf58.29.100"), ("ffmpeg", "Lavc58.54.100")]
    assert found(b"\0" * (1 << 20) + b"dBpoweramp" + b"\0" * (1 << 19)) == [] and found(b"\0" * (2 << 20) + b"dBpoweramp") == [("rip", "dBpoweramp")]
    assert found((24).to_bytes(4, "big") + b"ftypiso6\0\0\0\0dashmp41" + bytes(40)) == [("yt", "ftyp dash")]
    assert found(b"\x1aE\xdf\xa3....webm A_OPUS") == [("web", "WebM / Opus")]
    tagged = b"ID3\x03\0\0\0\0\0\x1f" + b"TENC" + (21).to_bytes(4, "big") + b"\0\0\x01" + "Audacity x".encode("utf-16") + b"\xff\xfb\x90\x00" + bytes(412)
    assert ("tool", "Audacity") in found(tagged)


def test_follow(spark, tmp_path):
    import os

    from catalune.sources.follow import look

    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    names = lambda d: sorted(r["path"].rsplit("/", 1)[-1] for r in d.collect())
    changed, gone, seen = look(spark, str(tmp_path))
    assert names(changed) == ["a", "b", "c"] and names(gone) == []
    os.utime(tmp_path / "a", (1, 1))  # another time, the same content: no change
    (tmp_path / "b").write_text("new")
    (tmp_path / "c").unlink()
    changed, gone, seen = look(spark, str(tmp_path), seen)
    assert names(changed) == ["b"] and names(gone) == ["c"] and names(seen) == ["a", "b"]
    changed, gone, _ = look(spark, str(tmp_path), seen)
    assert names(changed) == names(gone) == []


def test_backup_and_restore(spark, tmp_path):
    (tmp_path / "lib" / "sub").mkdir(parents=True)
    (tmp_path / "lib" / "a.json").write_text("{}")
    (tmp_path / "lib" / "sub" / "b.json").write_text("[1]")
    out = str(tmp_path / "backup")
    manifest = libraries.backup(spark, str(tmp_path / "lib"), out)
    assert sorted((r["path"], r["length"]) for r in manifest.collect()) == [("a.json", 2), ("sub/b.json", 3)]
    good, bad = libraries.restored(spark, out)
    assert {r["path"]: bytes(r["content"]) for r in good.collect()} == {"a.json": b"{}", "sub/b.json": b"[1]"} and bad.count() == 0
    kept = spark.read.parquet(f"{out}/files").where("path = 'a.json'").collect()
    spark.createDataFrame(kept).write.mode("append").parquet(f"{tmp_path}/other/files")
    manifest.write.parquet(f"{tmp_path}/other/manifest")
    good, bad = libraries.restored(spark, f"{tmp_path}/other")
    assert [r["path"] for r in good.collect()] == ["a.json"] and [r["path"] for r in bad.collect()] == ["sub/b.json"]
    libraries.write_whole(str(tmp_path / "x.json"), b"1")
    libraries.write_whole(str(tmp_path / "x.json"), b"2")
    assert (tmp_path / "x.json").read_bytes() == b"2" and not list(tmp_path.glob("*.tmp"))
