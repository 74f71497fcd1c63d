"""Note events from activations, pitch bends, and standard MIDI files, in numpy and bytes."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the transcription's output: rate, samples a frame, lowest pitch (A0) and its frequency, pitches, bins a semitone in
#: contours, frames a window and samples of it, seconds that a window is late, MIDI's bend range.
RATE, HOP, LOWEST, LOWEST_HZ, PITCHES, PER_SEMITONE = 22050, 256, 21, 27.5, 88, 3
WINDOW_FRAMES, WINDOW_SAMPLES, LATE, BEND_TICKS = 172, 43844, 0.0018, 8192


def frequencies(per_semitone: int = 1) -> np.ndarray:
    """The bins' frequencies: of notes (1) or contours (3)."""
    return LOWEST_HZ * 2 ** (np.arange(PITCHES * per_semitone) / (12 * per_semitone))


def contour_bin(pitch) -> np.ndarray:
    """The bin (a fraction of one) of a MIDI pitch in contours."""
    return 12 * PER_SEMITONE * np.log2(440 * 2 ** ((np.asarray(pitch, float) - 69) / 12) / LOWEST_HZ)


def frame_times(n: int) -> np.ndarray:
    """Seconds of each frame, with the correction of windows that overlap."""
    k = np.arange(n)
    late = HOP / RATE * (WINDOW_FRAMES - WINDOW_SAMPLES / HOP) + LATE
    return k * HOP / RATE - late * (k // WINDOW_FRAMES)


def inferred_onsets(onsets: np.ndarray, frames: np.ndarray, steps: int = 2) -> np.ndarray:
    """The larger of the onsets and the frames' rises over one to ``steps`` frames, these at the onsets' largest value."""
    rise = np.full(frames.shape, np.inf)
    for k in range(1, steps + 1):
        before = np.zeros_like(frames)
        before[k:] = frames[:-k] if k < len(frames) else 0
        rise = np.minimum(rise, frames - before)
    rise = np.maximum(rise, 0)
    rise[:steps] = 0
    top = rise.max() if rise.size else 0
    return np.maximum(onsets, rise * (onsets.max() / top)) if top > 0 else onsets.copy()


def between(activations: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """Zero outside the frequencies: pitches from that of ``low`` on, and below that of ``high``."""
    out = activations.copy()
    row = lambda hz: int(np.clip(np.round(12 * np.log2(hz / 440) + 69 - LOWEST), 0, out.shape[1]))
    if high is not None:
        out[:, row(high) :] = 0
    if low is not None:
        out[:, : row(low)] = 0
    return out


class _Energy:
    """What activations no note has used yet."""

    def __init__(self, frames: np.ndarray, threshold: float, tolerance: int):
        self.left, self.threshold, self.tolerance = frames.copy(), threshold, tolerance
        self.last = len(frames) - 1

    def use(self, start: int, end: int, pitch: int) -> None:
        self.left[start:end, max(0, pitch - 1) : pitch + 2] = 0

    def run(self, at: int, pitch: int, step: int) -> tuple[int, int]:
        """Where the pitch has lain under the threshold for the tolerance, in steps from a frame on, or the end; and how many quiet frames that took."""
        quiet = 0
        while (at < self.last if step > 0 else at > 0) and quiet < self.tolerance:
            quiet = quiet + 1 if self.left[at, pitch] < self.threshold else 0
            at += step
        return at, quiet


def trace(frames: np.ndarray, peaks: list[tuple[int, int]], frame: float = 0.3, least: int = 11, melodia: bool = True, tolerance: int = 11) -> list[tuple[int, int, int]]:
    """(start, end, pitch from 0) of notes in (time, pitch) energies, as they are found.

    Onset peaks (frame, pitch; in order) are taken from the last to the first; a note runs on until the energy lies under ``frame`` for
    ``tolerance`` frames; what it used, and its neighbours in pitch, no longer counts. Then, with ``melodia``, notes without
    onsets: from the largest energy that is left both ways.
    """
    energy, notes = _Energy(frames, frame, tolerance), []
    for start, pitch in reversed(peaks):
        if start >= energy.last:
            continue
        end, quiet = energy.run(start + 1, pitch, 1)
        end -= quiet
        if end - start > least:
            energy.use(start, end, pitch)
            notes.append((start, end, pitch))
    while melodia:
        middle, pitch = divmod(int(energy.left.argmax()), frames.shape[1])
        if not energy.left[middle, pitch] > frame:
            break
        energy.left[middle, pitch] = 0
        after, quiet_after = energy.run(middle + 1, pitch, 1)
        before, quiet_before = energy.run(middle - 1, pitch, -1)
        # all that was looked at is used, the quiet frames too
        energy.use(middle + 1, after, pitch)
        energy.use(before + 1, middle, pitch)
        start, end = before + 1 + quiet_before, after - 1 - quiet_after
        if end - start > least:
            notes.append((start, end, pitch))
    return notes


def decode(frames: np.ndarray, onsets: np.ndarray, onset: float = 0.5, frame: float = 0.3, least: int = 11, infer: bool = True, low: float | None = None, high: float | None = None, melodia: bool = True, tolerance: int = 11) -> list[tuple[int, int, int, float]]:
    """(start, end, MIDI pitch, mean activation) of notes in (time, pitch) activations, in order."""
    frames, onsets = (between(np.asarray(a, float), low, high) for a in (frames, onsets))
    if len(frames) < 3:
        return []
    onsets = inferred_onsets(onsets, frames) if infer else onsets
    peak = np.zeros(onsets.shape, bool)
    peak[1:-1] = (onsets[1:-1] > onsets[:-2]) & (onsets[1:-1] > onsets[2:]) & (onsets[1:-1] >= onset)
    found = trace(frames, [tuple(x) for x in np.argwhere(peak).tolist()], frame, least, melodia, tolerance)
    return sorted((s, e, p + LOWEST, float(frames[s:e, p].mean())) for s, e, p in found)


def bends(contours: np.ndarray, notes: list[tuple], reach: int = 25, spread: float = 5.0) -> list[list[int]]:
    """Of each note, frame by frame, how many thirds of a semitone its strongest contour lies off its pitch, near ones preferred."""
    contours = np.asarray(contours, float)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    out = []
    for start, end, pitch, *_ in notes:
        centre = int(np.round(contour_bin(pitch)))
        low, high = max(0, centre - reach), min(contours.shape[1], centre + reach + 1)
        part = contours[start:end, low:high] * weight[low - centre + reach : high - centre + reach]
        out.append((part.argmax(axis=1) + low - centre).tolist() if part.size else [])
    return out


def bend_ticks(values) -> np.ndarray:
    """MIDI bend of thirds of a semitone, for a range of two semitones either way."""
    return np.clip(np.round(np.asarray(values, float) * 4096 / PER_SEMITONE), -BEND_TICKS, BEND_TICKS - 1).astype(int)


def _varied(n: int) -> bytes:
    """A number in groups of seven bits."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def build_midi(notes: list[tuple], tempo: float = 120.0, division: int = 480, program: int = 4) -> bytes:
    """A one-track file of (start seconds, end seconds, pitch, amplitude 0 to 1, bends or None)."""
    ticks = lambda t: int(round(t * tempo / 60 * division))
    events = [(0, 0, b"\xff\x51\x03" + int(round(60e6 / tempo)).to_bytes(3, "big")), (0, 1, bytes([0xC0, program]))]
    for start, end, pitch, amplitude, bent in notes:
        events.append((ticks(start), 4, bytes([0x90, pitch, int(np.round(127 * amplitude))])))
        events.append((ticks(end), 2, bytes([0x80, pitch, 0])))
        for t, b in zip(np.linspace(start, end, len(bent or ())), bend_ticks(bent or ()), strict=True):
            value = int(b) + BEND_TICKS
            events.append((ticks(t), 3, bytes([0xE0, value & 127, value >> 7])))
    track, now = b"", 0
    for at, _, data in sorted(events, key=lambda e: e[:2]):
        track += _varied(at - now) + data
        now = at
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(track)) + track


def _tracks(data: bytes) -> tuple[int, list[list[tuple[int, int, bytes]]]]:
    """Ticks a quarter, and of each track (tick, status, data)."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, count, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("MIDI files in frames of film time are not read")
    at, tracks = 8 + size, []
    while at + 8 <= len(data) and len(tracks) < count:
        kind, n = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body, at = data[at + 8 : at + 8 + n], at + 8 + n
        if kind != b"MTrk":
            continue
        i, tick, status, events = 0, 0, 0, []

        def number(i: int, body: bytes = body) -> tuple[int, int]:
            value = 0
            while True:
                value, i = value << 7 | body[i] & 127, i + 1
                if not body[i - 1] & 128:
                    return value, i

        while i < len(body):
            step, i = number(i)
            tick += step
            now = status
            if body[i] & 128:
                now, i = body[i], i + 1
                status = now if now < 0xF0 else status  # running status goes on behind other events
            if now == 0xFF:
                kind_, i = body[i], i + 1
                length, i = number(i)
                events.append((tick, 0xFF00 | kind_, body[i : i + length]))
                i += length
            elif now in (0xF0, 0xF7):
                length, i = number(i)
                i += length
            else:
                length = 1 if now & 0xF0 in (0xC0, 0xD0) else 2
                events.append((tick, now, body[i : i + length]))
                i += length
        tracks.append(events)
    return division, tracks


def parse_midi(data: bytes) -> list[tuple[float, float, int, int]]:
    """(start, end, pitch, velocity) in seconds, in order: notes of all tracks and channels. A note that is not ended has none."""
    division, tracks = _tracks(data)
    tempos = sorted((t, int.from_bytes(d, "big")) for events in tracks for t, s, d in events if s == 0xFF51)
    tempos = [(0, 500_000), *tempos]
    ticks, each = np.array([t for t, _ in tempos]), np.array([u / 1e6 / division for _, u in tempos])
    base = np.concatenate([[0.0], np.cumsum(np.diff(ticks) * each[:-1])])

    def seconds(t: int) -> float:
        k = int(np.searchsorted(ticks, t, "right")) - 1
        return float(base[k] + (t - ticks[k]) * each[k])

    notes = []
    for events in tracks:
        open_: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for tick, status, d in events:
            if status >= 0xFF00 or status & 0xE0 != 0x80:
                continue
            key = (status & 15, d[0])
            if status & 0xF0 == 0x90 and d[1]:
                open_.setdefault(key, []).append((tick, d[1]))
            elif open_.get(key):
                start, velocity = open_[key].pop(0)
                notes.append((seconds(start), seconds(tick), d[0], velocity))
    return sorted(notes)
