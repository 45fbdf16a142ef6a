"""The Standard security handler, revisions 2 to 6."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5
from hmac import compare_digest
from typing import Any

from . import crypto
from .lexer import Name
from .limits import Budget, limit

# Fixed value of the PDF specification.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
REVISIONS = {(2, 1), (3, 2), (4, 4), (5, 5), (6, 5)}
METHODS = {4: {"None", "V2", "AESV2"}, 5: {"None", "AESV3"}}


def _md5(data: bytes) -> bytes:
    return md5(data, usedforsecurity=False).digest()


def hash_r6(password: bytes, salt: bytes, user: bytes = b"", budget: Budget | None = None) -> bytes:
    key, size = _hash_r6(password, salt, user)
    if budget:
        budget.deadline()
        budget.work(size)
    return key


@lru_cache(maxsize=1024)
def _hash_r6(password: bytes, salt: bytes, user: bytes) -> tuple[bytes, int]:
    """The hash and how many bytes went through the cipher. Kept, as a hash costs a second and files are tried with one password each."""
    key = hashlib.sha256(password + salt + user).digest()
    n = size = 0
    while True:
        block = (password + key + user) * 64
        size += len(block)
        block = crypto.aes_cbc_encrypt(block, key[:16], key[16:32])
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        n += 1
        if n >= 64 and block[-1] <= n - 32:
            return key[:32], size


def file_key(padded: bytes, owner: bytes, permissions: int, document_id: bytes, revision: int, length: int, clear_metadata: bool) -> bytes:
    """Revisions 2 to 4."""
    h = _md5(padded + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + document_id + (b"\xff" * 4 if revision >= 4 and clear_metadata else b""))
    for _ in range(50 if revision >= 3 else 0):
        h = _md5(h[:length])
    return h[:length]


def rc4_rounds(data: bytes, key: bytes, rounds) -> bytes:  # noqa: ANN001
    for i in rounds:
        data = crypto.rc4(data, bytes(k ^ i for k in key))
    return data


def user_entry(key: bytes, document_id: bytes, revision: int) -> bytes:
    """What /U begins with."""
    return crypto.rc4(PADDING, key) if revision == 2 else rc4_rounds(_md5(PADDING + document_id), key, range(20))


@lru_cache(maxsize=1024)
def owner_key(padded: bytes, revision: int, length: int) -> bytes:
    h = _md5(padded)
    for _ in range(50 if revision >= 3 else 0):
        h = _md5(h)
    return h[:length]


def object_key(key: bytes, id_: int, generation: int, aes: bool) -> bytes:
    salt = b"sAlT" if aes else b""
    return _md5(key + id_.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + salt)[: min(len(key) + 5, 16)]


@dataclass
class Handler:
    key: bytes
    strings: str = "V2"
    streams: str = "V2"
    filters: dict[str, str] = field(default_factory=dict)
    clear_metadata: bool = False

    def decrypt(self, data: bytes, id_: int, generation: int, method: str, budget: Budget) -> bytes | None:
        budget.deadline()
        if method == "None":
            return data
        if method not in ("V2", "AESV2", "AESV3"):
            return None
        if len(data) > budget.options.maxStreamBytes:
            raise limit("Encrypted data exceeds maxStreamBytes.")
        budget.work(len(data))
        key = self.key if method == "AESV3" else object_key(self.key, id_, generation, method == "AESV2")
        if method == "V2":
            return crypto.rc4(data, key)
        if len(data) < 32 or len(data) % 16:
            return None
        return crypto.unpad(crypto.aes_cbc_decrypt(data[16:], key, data[:16]))

    def stream(self, data: bytes, id_: int, generation: int, entries: dict, resolve, budget: Budget) -> bytes | None:  # noqa: ANN001
        kind = entries.get("Type")
        if kind == "XRef" or (self.clear_metadata and kind == "Metadata"):
            return data
        method = self.streams
        names = resolve(entries.get("Filter"))
        names = [resolve(x) for x in names] if isinstance(names, list) else [names]
        if "Crypt" in names:
            if names.index("Crypt"):
                return None
            given = resolve(entries.get("DecodeParms"))
            given = resolve(given[0] if isinstance(given, list) and given else given)
            name = resolve(given.get("Name", Name("Identity"))) if isinstance(given, dict) else "Identity"
            method = self.filters.get(name, "Unsupported")
        return self.decrypt(data, id_, generation, method, budget)


def _int(x: Any, default: int = 0) -> int:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else default


def authenticate(d: Any, document_id: bytes, password: bytes, budget: Budget) -> Handler | None:
    """The handler if the password is the user's or the owner's."""
    budget.deadline()
    if not isinstance(d, dict) or d.get("Filter") != "Standard" or "P" not in d:
        return None
    revision, version = _int(d.get("R")), _int(d.get("V"))
    if (revision, version) not in REVISIONS:
        return None
    data = {k: d[k] if isinstance(d.get(k), bytes) else b"" for k in ("O", "U", "OE", "UE", "Perms")}
    out = Handler(b"", clear_metadata=d.get("EncryptMetadata") is False)
    if version >= 4:
        out.filters = {"Identity": "None"}
        for name, crypt in (d["CF"] if isinstance(d.get("CF"), dict) else {}).items():
            method = crypt.get("CFM", "None") if isinstance(crypt, dict) else "None"
            if method not in METHODS[version]:
                return None
            out.filters[name] = str(method)
        found = [out.filters.get(d.get(k, "Identity")) for k in ("StmF", "StrF")]
        if None in found:
            return None
        out.streams, out.strings = found
    permissions = _int(d["P"])
    if revision >= 5:
        return _modern(out, data, permissions, password[:127], revision, budget)
    if len(data["O"]) != 32 or len(data["U"]) != 32 or not document_id:
        return None
    bits = 40 if revision == 2 else _int(d.get("Length"), 40)
    if not 40 <= bits <= 128 or bits % 8 or ("AESV2" in (out.streams, out.strings) and bits != 128):
        return None
    length = bits // 8
    padded = (password + PADDING)[:32]
    for as_owner in (False, True):
        own = rc4_rounds(data["O"], owner_key(padded, revision, length), range(19, -1, -1) if revision >= 3 else (0,)) if as_owner else padded
        key = file_key(own, data["O"], permissions, document_id, revision, length, out.clear_metadata)
        expected = user_entry(key, document_id, revision)
        if compare_digest(expected, data["U"][: len(expected)]):
            out.key = key
            return out
    return None


def _modern(out: Handler, data: dict[str, bytes], permissions: int, password: bytes, revision: int, budget: Budget) -> Handler | None:
    if [len(data[k]) for k in ("O", "U", "OE", "UE", "Perms")] != [48, 48, 32, 32, 16]:
        return None

    def digest(salt: bytes, user: bytes) -> bytes:
        return hashlib.sha256(password + salt + user).digest() if revision == 5 else hash_r6(password, salt, user, budget)

    for entry, wrapped, user in ((data["U"], data["UE"], b""), (data["O"], data["OE"], data["U"])):
        if compare_digest(digest(entry[32:40], user), entry[:32]):
            key = crypto.aes_cbc_decrypt(wrapped, digest(entry[40:48], user), bytes(16))
            perms = (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"F" if out.clear_metadata else b"T") + b"adb"
            if not compare_digest(crypto.aes_ecb_decrypt(data["Perms"], key)[:12], perms):
                return None
            out.key = key
            return out
    return None
