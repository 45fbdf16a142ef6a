"""AES and RC4: by the libcrypto that Python's own hashes use, where it has them, else by plain Python, whose tables come from
the field arithmetic and whose decryption works on all blocks at once."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out & 0xFF


def _sbox() -> bytes:
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    out = []
    for x in inverse:
        y = x
        for k in range(1, 5):
            y ^= (x << k | x >> 8 - k) & 0xFF
        out.append(y ^ 0x63)
    return bytes(out)


SBOX = _sbox()
_S = np.frombuffer(SBOX, np.uint8)
_INV = np.argsort(_S).astype(np.uint8)
_MUL = {k: np.array([_times(k, x) for x in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
#: State bytes are in column order; row r moves left by r.
_SHIFT = np.array([(4 * c + r + 4 * r) % 16 for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)
# One table for each row of the state: a byte's part of its mixed column, as a 32-bit word.
_ENC = [[0] * 256 for _ in range(4)]
for _x in range(256):
    _s = SBOX[_x]
    _column = [_times(_s, 2), _s, _s, _times(_s, 3)]
    for _r in range(4):
        _ENC[_r][_x] = int.from_bytes(bytes(_column[(i - _r) % 4] for i in range(4)), "big")


@lru_cache(maxsize=256)
def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(SBOX[x] for x in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            w = bytes(SBOX[x] for x in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _unmix(s: np.ndarray) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    out = np.empty_like(c)
    for r in range(4):
        out[:, :, r] = _MUL[14][c[:, :, r]] ^ _MUL[11][c[:, :, (r + 1) % 4]] ^ _MUL[13][c[:, :, (r + 2) % 4]] ^ _MUL[9][c[:, :, (r + 3) % 4]]
    return out.reshape(-1, 16)


def _ecb_decrypt(data: bytes, key: bytes) -> bytes:
    keys = [np.frombuffer(k, np.uint8) for k in _round_keys(key)]
    s = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _unmix(_INV[s[:, _UNSHIFT]] ^ k)
    return (_INV[s[:, _UNSHIFT]] ^ keys[0]).tobytes()


def _cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    plain = np.frombuffer(_ecb_decrypt(data, key), np.uint8)
    return (plain ^ np.frombuffer(iv + data[:-16], np.uint8)).tobytes()


def _cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """A block needs the one before, so this goes one by one."""
    keys = [[int.from_bytes(k[4 * i : 4 * i + 4], "big") for i in range(4)] for k in _round_keys(key)]
    t0, t1, t2, t3 = _ENC
    sbox, out = SBOX, bytearray()
    a, b, c, d = (int.from_bytes(iv[4 * i : 4 * i + 4], "big") for i in range(4))
    middle, last = keys[1:-1], keys[-1]
    for at in range(0, len(data), 16):
        block = int.from_bytes(data[at : at + 16], "big")
        a ^= block >> 96 ^ keys[0][0]
        b ^= block >> 64 & 0xFFFFFFFF ^ keys[0][1]
        c ^= block >> 32 & 0xFFFFFFFF ^ keys[0][2]
        d ^= block & 0xFFFFFFFF ^ keys[0][3]
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        a, b, c, d = (
            (sbox[w >> 24] << 24 | sbox[x >> 16 & 255] << 16 | sbox[y >> 8 & 255] << 8 | sbox[z & 255]) ^ k
            for (w, x, y, z), k in zip(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)), last, strict=True)
        )
        out += (a << 96 | b << 64 | c << 32 | d).to_bytes(16, "big")
    return bytes(out)


def pad(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpad(data: bytes) -> bytes | None:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data[-n:] == bytes([n]) * n else None


def _rc4(data: bytes, key: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = i + 1 & 255
        x = s[i]
        j = j + x & 255
        y = s[j]
        s[i], s[j] = y, x
        out[n] = byte ^ s[x + y & 255]
    return bytes(out)


#: Bytes that hold libcrypto's key schedules: AES has 61 words, RC4 at most 258.
_AES_KEY, _RC4_KEY = 256, 2112


def _library() -> ctypes.CDLL | None:
    """libcrypto, if it is there and agrees with the plain forms."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        p, n = ctypes.c_char_p, ctypes.c_void_p
        for name, kinds in (
            ("AES_set_encrypt_key", (p, ctypes.c_int, n)),
            ("AES_set_decrypt_key", (p, ctypes.c_int, n)),
            ("AES_cbc_encrypt", (p, n, ctypes.c_size_t, n, n, ctypes.c_int)),
            ("RC4_set_key", (n, ctypes.c_int, p)),
            ("RC4", (n, ctypes.c_size_t, p, n)),
        ):
            getattr(lib, name).argtypes = kinds
        data, iv = bytes(range(48)), bytes(range(100, 116))
        for size in (16, 32):
            key = bytes(range(7, 7 + size))
            if _lib_cbc(lib, data, key, iv, True) != _cbc_encrypt(data, key, iv) or _lib_cbc(lib, data, key, iv, False) != _cbc_decrypt(data, key, iv):
                return None
        if any(_lib_rc4(lib, data, key) != _rc4(data, key) for key in (b"Key", data[:5], data[:16])):
            return None
    except (ImportError, OSError, AttributeError, ValueError):
        return None
    return lib


def _lib_cbc(lib: ctypes.CDLL, data: bytes, key: bytes, iv: bytes, encrypt: bool) -> bytes:
    schedule, out = ctypes.create_string_buffer(_AES_KEY), ctypes.create_string_buffer(len(data) or 1)
    if (lib.AES_set_encrypt_key if encrypt else lib.AES_set_decrypt_key)(key, 8 * len(key), schedule):
        raise ValueError("AES key")
    lib.AES_cbc_encrypt(data, out, len(data), schedule, ctypes.create_string_buffer(iv, 16), int(encrypt))
    return out.raw[: len(data)]


def _lib_rc4(lib: ctypes.CDLL, data: bytes, key: bytes) -> bytes:
    schedule, out = ctypes.create_string_buffer(_RC4_KEY), ctypes.create_string_buffer(len(data) or 1)
    lib.RC4_set_key(schedule, len(key), key)
    lib.RC4(schedule, len(data), data, out)
    return out.raw[: len(data)]


_LIB = _library()


def _fits(data: bytes, key: bytes) -> bool:
    return _LIB is not None and not len(data) % 16 and len(key) in (16, 24, 32)


def aes_ecb_decrypt(data: bytes, key: bytes) -> bytes:
    return aes_cbc_decrypt(data, key, bytes(16)) if len(data) == 16 else _ecb_decrypt(data, key)


def aes_cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """Without padding."""
    return _lib_cbc(_LIB, bytes(data), key, iv, False) if _fits(data, key) else _cbc_decrypt(data, key, iv)


def aes_cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """Without padding."""
    return _lib_cbc(_LIB, bytes(data), key, iv, True) if _fits(data, key) else _cbc_encrypt(data, key, iv)


def rc4(data: bytes, key: bytes) -> bytes:
    return _lib_rc4(_LIB, bytes(data), key) if _LIB is not None else _rc4(data, key)
