import gzip
import struct

from seqloom import sources


def record(name, flag, ref, pos, cigar, seq, qual, tags=b""):
    codes = "=ACMGRSVTWYHKDBN"
    bits = [codes.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(bits[::2], bits[1::2], strict=True))
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    body = struct.pack("<iiBBHHHIiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(qual) + tags
    return struct.pack("<I", len(body)) + body


def test_read_bam(spark, tmp_path):
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<I", len(text)) + text + struct.pack("<I", 1) + struct.pack("<I", 5) + b"chr1\0" + struct.pack("<I", 1000)
    tags = b"NMC\x02" + b"RGZone\0" + b"XBBs" + struct.pack("<Ihh", 2, -1, 7)
    body = record("r1", 16, 0, 9, [(3, "M"), (1, "I"), (1, "S")], "ACGTN", [30, 31, 32, 33, 2], tags) + record("r2", 4, -1, -1, [], "A", [0xFF])
    raw = head + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:40]) + gzip.compress(raw[40:]) + gzip.compress(b""))
    rows = sorted(sources.read(spark, str(tmp_path / "a.bam")).collect())
    assert rows[0][:11] == ("r1", 16, "chr1", 10, 60, "3M1I1S", "*", 0, 0, "ACGTN", "?@AB#")
    assert rows[0].tags == {"NM:i": "2", "RG:Z": "one", "XB:B": "s,-1,7"}
    assert rows[1][:11] == ("r2", 4, "*", 0, 60, "*", "*", 0, 0, "A", "*")
