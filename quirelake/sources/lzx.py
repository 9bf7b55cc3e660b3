"""LZX, the compression of help files, after its published description."""

from __future__ import annotations

from .model import ParseError

FRAME = 32768
VERBATIM, ALIGNED, STORED = 1, 2, 3


class Bits:
    """Bits of 16-bit little-endian words, highest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            word = int.from_bytes(self.data[self.at : self.at + 2].ljust(2, b"\0"), "little")
            self.at += 2
            if self.at > len(self.data) + 8:
                raise ParseError("LZX data ends early")
            self.held = (self.held << 16 | word) & 0xFFFFFFFFFFFF
            self.n += 16

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def code(self, table: dict[tuple[int, int], int]) -> int:
        value = 0
        for n in range(1, 17):
            value = value << 1 | self.read(1)
            if (n, value) in table:
                return table[n, value]
        raise ParseError("LZX code is in no table")


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol: shorter codes first, then by symbol."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[n, code] = symbol
        code, last = code + 1, n
    return out


def slots(bits: int) -> list[tuple[int, int]]:
    """(first position, extra bits) of each position slot of a window of 2**bits bytes."""
    out, base, slot = [], 0, 0
    while base < 1 << bits:
        extra = 0 if slot < 4 else min(17, slot // 2 - 1)
        out.append((base, extra))
        base += 1 << extra
        slot += 1
    return out


class Decoder:
    """Frames of one stretch between resets."""

    def __init__(self, bits: int):
        self.slots, self.out = slots(bits), bytearray()
        self.recent = [1, 1, 1]
        self.main, self.length = [0] * (256 + 8 * len(self.slots)), [0] * 249
        self.left, self.kind, self.started, self.calls = 0, 0, False, 0

    def _lengths(self, b: Bits, lengths: list[int], a: int, z: int) -> None:
        pre = canonical([b.read(4) for _ in range(20)])
        while a < z:
            s = b.code(pre)
            if s == 17 or s == 18:
                n = b.read(4) + 4 if s == 17 else b.read(5) + 20
                lengths[a : min(a + n, z)] = [0] * (min(a + n, z) - a)
            elif s == 19:
                n = b.read(1) + 4
                value = (lengths[a] - b.code(pre)) % 17
                lengths[a : min(a + n, z)] = [value] * (min(a + n, z) - a)
            else:
                n = 1
                lengths[a] = (lengths[a] - s) % 17
            a += n

    def _block(self, b: Bits) -> None:
        self.kind = b.read(3)
        self.left = b.read(16) << 8 | b.read(8)
        if self.kind in (VERBATIM, ALIGNED):
            if self.kind == ALIGNED:
                self.aligned_table = canonical([b.read(3) for _ in range(8)])
            self._lengths(b, self.main, 0, 256)
            self._lengths(b, self.main, 256, len(self.main))
            self.main_table = canonical(self.main)
            self._lengths(b, self.length, 0, 249)
            self.length_table = canonical(self.length)
        elif self.kind == STORED:
            if b.n % 16 == 0:
                b.read(16)
            b.n -= b.n % 16
            b.at -= b.n // 8
            b.n = 0
            self.recent = [int.from_bytes(b.data[b.at + 4 * i : b.at + 4 * i + 4], "little") for i in range(3)]
            b.at += 12
        else:
            raise ParseError("unknown LZX block")

    def frame(self, data: bytes, size: int = FRAME) -> bytes:
        """The next frame; its bits start at a word."""
        b, begin = Bits(data), len(self.out)
        end = begin + size
        if not self.started:
            self.started = True
            self.translate = int(b.read(32)) if b.read(1) else 0
        while len(self.out) < end:
            if not self.left:
                self._block(b)
            stop = min(end, len(self.out) + self.left)
            before = len(self.out)
            if self.kind == STORED:
                n = stop - before
                self.out += b.data[b.at : b.at + n]
                b.at += n
                if len(self.out) < stop:
                    raise ParseError("LZX data ends early")
                if self.left == n and n % 2:
                    b.at += 1
            else:
                while len(self.out) < stop:
                    self._symbol(b)
            self.left -= len(self.out) - before
        self.calls += 1
        return self._translated(bytes(self.out[begin:end]), begin)

    def _symbol(self, b: Bits) -> None:
        s = b.code(self.main_table)
        if s < 256:
            self.out.append(s)
            return
        slot, head = divmod(s - 256, 8)
        n = head + 2 if head < 7 else b.code(self.length_table) + 9
        if slot < 3:
            distance = self.recent[slot]
            self.recent[slot], self.recent[0] = self.recent[0], distance
        else:
            base, extra = self.slots[slot]
            if self.kind == ALIGNED and extra >= 3:
                offset = base + (b.read(extra - 3) << 3) + b.code(self.aligned_table)
            else:
                offset = base + b.read(extra)
            distance = offset - 2
            self.recent = [distance, *self.recent[:2]]
        if not 0 < distance <= len(self.out):
            raise ParseError("LZX match before the start")
        for _ in range(n):
            self.out.append(self.out[-distance])

    def _translated(self, frame: bytes, begin: int) -> bytes:
        """x86 calls back from absolute to relative targets, if the stream says so."""
        if not self.translate or begin >= 1 << 30 or len(frame) <= 10:
            return frame
        out, i = bytearray(frame), 0
        while i < len(out) - 10:
            if out[i] != 0xE8:
                i += 1
                continue
            place = begin + i
            absolute = int.from_bytes(out[i + 1 : i + 5], "little", signed=True)
            if -place <= absolute < self.translate:
                relative = absolute - place if absolute >= 0 else absolute + self.translate
                out[i + 1 : i + 5] = relative.to_bytes(4, "little", signed=True)
            i += 5
        return bytes(out)
