import random

import pytest

from loomlog.functions import codecs


def test_castagnoli_check_value():
    assert codecs.crc32c(b"123456789") == 0xE3069283


def test_a_log_is_read_up_to_its_first_bad_record():
    rng = random.Random(1)
    records = [(k % 7, b"record-%06d-" % k + b"x" * (k % 50)) for k in range(40)]
    log = b"".join(codecs.frame(*r) for r in records)
    assert codecs.valid_prefix(log) == (records, len(log))
    for _ in range(50):
        cut = rng.randrange(len(log))
        got, size = codecs.valid_prefix(log[:cut] + bytes(rng.randrange(9)))
        assert got == records[: len(got)] and size <= cut
    bad = bytearray(log)
    bad[len(codecs.frame(*records[0])) + 12] ^= 1
    assert codecs.valid_prefix(bytes(bad))[0] == records[:1]


def test_pairs_round_trip_and_damage_is_an_error():
    pairs = [(b"", b""), (b"k", b"v" * 300), (b"\x00\xff", b"")]
    image = codecs.encode_pairs(pairs)
    assert list(codecs.decode_pairs(image)) == pairs
    with pytest.raises(ValueError):
        list(codecs.decode_pairs(image[:-1] + b"\x05"))
