"""Signal kernels in numpy, on stacks of signals (rows, samples): recursions loop over samples for all rows at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SILENT = float("-inf")


#: Samples of a block of a recursion.
BLOCK = 256


def iir(x: np.ndarray, b, a, clamp: bool = False) -> np.ndarray:
    """Recursive filter along the last axis, block by block: within a block the impulse response, and what the last
    outputs before the block add to it. Linear in the samples, for all rows at once."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    rows = np.atleast_2d(np.asarray(x, float))
    n, order = rows.shape[1], len(a) - 1
    fed = sum(c * np.pad(rows, ((0, 0), (k, 0)))[:, :n] for k, c in enumerate(b))
    if order and n:
        size = min(BLOCK, n)
        past = np.zeros((size + order, order + 1))  # responses to an impulse at 0, and to each of the outputs before
        past[order, 0] = 1
        past[:order, 1:] = np.eye(order)
        for k in range(size):
            past[order + k] -= a[1:] @ past[order + k - 1 :: -1][:order]
        answer, state = past[order:, 0], past[order:, 1:].T
        lag = np.arange(size)[None, :] - np.arange(size)[:, None]
        inside = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
        y, last = np.empty_like(rows), np.zeros((len(rows), order))
        for at in range(0, n, size):
            part = fed[:, at : at + size]
            m = part.shape[1]
            y[:, at : at + m] = part @ inside[:m, :m] + last @ state[:, :m]
            last = np.concatenate([last, y[:, at : at + m]], axis=1)[:, -order:]
    else:
        y = fed
    y = np.clip(y, -1, 1) if clamp else y
    return y.reshape(np.shape(x))


def biquad(kind: str, sr: float, freq: float, q: float = 0.7071067811865476, gain_db: float = 0.0):
    """Coefficients (b, a) by the audio EQ cookbook formulas."""
    w = 2 * np.pi * freq / sr
    cos, alpha, amp = np.cos(w), np.sin(w) / (2 * q), 10 ** (gain_db / 40)
    root = 2 * np.sqrt(amp) * alpha
    if kind == "lowpass":
        return ((1 - cos) / 2, 1 - cos, (1 - cos) / 2), (1 + alpha, -2 * cos, 1 - alpha)
    if kind == "highpass":
        return ((1 + cos) / 2, -(1 + cos), (1 + cos) / 2), (1 + alpha, -2 * cos, 1 - alpha)
    if kind == "bandpass":
        return (alpha, 0.0, -alpha), (1 + alpha, -2 * cos, 1 - alpha)
    if kind == "allpass":
        return (1 - alpha, -2 * cos, 1 + alpha), (1 + alpha, -2 * cos, 1 - alpha)
    if kind == "peak":
        return (1 + alpha * amp, -2 * cos, 1 - alpha * amp), (1 + alpha / amp, -2 * cos, 1 - alpha / amp)
    sign = {"lowshelf": 1, "highshelf": -1}[kind]
    b = (amp * (amp + 1 - sign * (amp - 1) * cos + root), sign * 2 * amp * (amp - 1 - sign * (amp + 1) * cos), amp * (amp + 1 - sign * (amp - 1) * cos - root))
    a = (amp + 1 + sign * (amp - 1) * cos + root, sign * -2 * (amp - 1 + sign * (amp + 1) * cos), amp + 1 + sign * (amp - 1) * cos - root)
    return b, a


def loudness(x: np.ndarray, sr: int) -> float:
    """Gated loudness in LUFS of (channels, samples); silence is minus infinity.

    Fixed values: gate 0.4 s with steps of a quarter, shelf +4 dB at 1500 Hz, high-pass 38 Hz with q 0.5, channel
    weights 1 1 1 1.41 1.41, offset -0.691, absolute gate -70, relative gate -10. Filters clamp to [-1, 1].
    """
    x = np.atleast_2d(np.asarray(x, float))
    if x.shape[0] > 5:
        raise ValueError("five channels at most")
    if not x.shape[1]:
        return SILENT
    block = max(1, round(min(0.4, x.shape[1] / sr) * sr))
    step = max(1, round(block * 0.25))
    y = iir(x, *biquad("highshelf", sr, 1500, 1 / np.sqrt(2), 4.0), clamp=True)
    y = iir(y, *biquad("highpass", sr, 38, 0.5), clamp=True)
    blocks = np.lib.stride_tricks.sliding_window_view(y, block, axis=1)[:, ::step]
    energy = (blocks**2).mean(axis=2)
    weight = np.array([1, 1, 1, 1.41, 1.41])[: x.shape[0]]
    with np.errstate(divide="ignore"):
        level = lambda e: -0.691 + 10 * np.log10(weight @ e)
        each = level(energy)
        loud = energy[:, each > -70]
        if not loud.shape[1]:
            return SILENT
        kept = energy[:, (each > -70) & (each > level(loud.mean(axis=1)) - 10)]
        return float(level(kept.mean(axis=1))) if kept.shape[1] else SILENT


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Centred frames with reflected ends."""
    half = size // 2
    padded = np.pad(x, half, mode="reflect") if len(x) > half else np.pad(np.pad(x, (0, max(0, half + 1 - len(x)))), half, mode="reflect")
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    return np.fft.rfft(frames(np.asarray(x, float), n_fft, hop) * np.hanning(n_fft + 1)[:-1], axis=1).T


def istft(spec: np.ndarray, n_fft: int, hop: int, length: int) -> np.ndarray:
    window = np.hanning(n_fft + 1)[:-1]
    parts = np.fft.irfft(spec.T, n_fft, axis=1) * window
    out, norm = np.zeros(n_fft + hop * (len(parts) - 1)), np.zeros(n_fft + hop * (len(parts) - 1))
    for k, p in enumerate(parts):
        out[k * hop : k * hop + n_fft] += p
        norm[k * hop : k * hop + n_fft] += window**2
    y = (out / np.maximum(norm, 1e-10))[n_fft // 2 :]
    return np.pad(y, (0, max(0, length - len(y))))[:length]


def htk_mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def htk_hz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def slaney_mel(f):
    """Linear to 1000 Hz (3 bands in 200 Hz), then 27 bands for each factor of 6.4."""
    f = np.asarray(f, float)
    return np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1000) / 1000) / np.log(6.4))


def slaney_hz(m):
    m = np.asarray(m, float)
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))


def mel_bank(sr: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None, scale: str = "htk") -> np.ndarray:
    """Triangles evenly spaced on a mel scale, htk or slaney."""
    to, back = {"htk": (htk_mel, htk_hz), "slaney": (slaney_mel, slaney_hz)}[scale]
    edges = back(np.linspace(to(low), to(high or sr / 2), n_mels + 2))
    f = np.arange(n_fft // 2 + 1) * sr / n_fft
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel(x: np.ndarray, sr: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> np.ndarray:
    return mel_bank(sr, n_fft, n_mels) @ np.abs(stft(x, n_fft, hop)) ** 2


def log_mel(x: np.ndarray, sr: int = 22050) -> np.ndarray:
    """Beat front end (bands, frames): log1p of 1000 times the mel amplitudes. 128 slaney bands from 30 to 11000 Hz,
    frames of 1024 every 441, divided by the square root of the frame length."""
    return np.log1p(1000 * (mel_bank(sr, 1024, 128, 30, 11000, "slaney") @ np.abs(stft(x, 1024, 441)) / np.sqrt(1024)))


def cqt(x: np.ndarray, sr: int, hop: int = 512, fmin: float = 32.70319566257483, n_bins: int = 84, per_octave: int = 12) -> np.ndarray:
    """Direct constant-Q transform; real and imaginary parts stacked on the first axis. All frames of a bin at once."""
    x = np.asarray(x, float)
    q = 1 / (2 ** (1 / per_octave) - 1)
    at = np.arange(0, max(len(x), 1), hop)
    rows = []
    for k in range(n_bins):
        f = fmin * 2 ** (k / per_octave)
        n = max(2, min(int(np.ceil(q * sr / f)), 8 * max(len(x), 1)))
        kernel = np.hanning(n + 2)[1:-1] * np.exp(-2j * np.pi * f / sr * (np.arange(n) - n / 2)) / n
        padded = np.pad(x, (n // 2 + 1, n))
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, n)[at] @ kernel)
    c = np.array(rows)
    return np.stack([c.real, c.imag])


def _difference(parts: np.ndarray, longest: int) -> np.ndarray:
    """YIN's difference function of each frame, divided by its running mean: lags 1 to ``longest``."""
    frame = parts.shape[1]
    w = frame - longest
    cross = np.fft.irfft(np.fft.rfft(parts, 2 * frame) * np.fft.rfft(parts[:, :w], 2 * frame).conj())[:, : longest + 1]
    power = np.concatenate([np.zeros((len(parts), 1)), np.cumsum(parts**2, axis=1)], axis=1)
    d = power[:, w : w + 1] + (power[:, w : w + longest + 1] - power[:, : longest + 1]) - 2 * cross
    return d[:, 1:] * np.arange(1, longest + 1) / np.maximum(np.cumsum(d[:, 1:], axis=1), 1e-12)


def _bent(norm: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the parabola through a dip and its neighbours is least, relative to it; rows and places."""
    rows = np.arange(len(norm))
    inner = (k > 0) & (k < norm.shape[1] - 1)
    a, b, c = (norm[rows, np.clip(k + j, 0, norm.shape[1] - 1)] for j in (-1, 0, 1))
    bend = a - 2 * b + c
    return np.where(inner & (bend > 1e-12), np.clip(0.5 * (a - c) / np.where(bend > 1e-12, bend, 1), -1, 1), 0.0)


def _lags(sr: int, fmin: float, fmax: float, frame: int) -> tuple[int, int]:
    return max(1, int(sr / fmax)), min(int(np.ceil(sr / fmin)), frame // 2)


def yin(x: np.ndarray, sr: int, fmin: float = 65.40639, fmax: float = 2093.0045, frame: int = 2048, hop: int = 512, trough: float = 0.1) -> np.ndarray:
    """f0 of each frame: the first dip of the normalised difference under the threshold, else its least; 0 for silence."""
    parts = frames(np.asarray(x, float), frame, hop)
    shortest, longest = _lags(sr, fmin, fmax, frame)
    norm = _difference(parts, longest)
    search = norm[:, shortest - 1 :]
    dip = np.zeros(search.shape, bool)
    dip[:, 1:-1] = (search[:, 1:-1] < trough) & (search[:, 1:-1] <= search[:, :-2]) & (search[:, 1:-1] <= search[:, 2:])
    k = np.where(dip.any(axis=1), dip.argmax(axis=1), search.argmin(axis=1)) + shortest - 1
    out = np.where(np.abs(parts).max(axis=1) > 1e-8, sr / (k + 1 + _bent(norm, k)), 0.0)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


@lru_cache(maxsize=16)
def _beta_mass(thresholds: int, a: float, b: float) -> np.ndarray:
    """The beta distribution's mass between thresholds."""
    fine = (np.arange(20 * thresholds) + 0.5) / (20 * thresholds)
    density = fine ** (a - 1) * (1 - fine) ** (b - 1)
    return density.reshape(thresholds, 20).sum(axis=1) / density.sum()


def pyin(x: np.ndarray, sr: int, fmin: float = 65.40639, fmax: float = 2093.0045, frame: int = 2048, hop: int = 512, thresholds: int = 100, beta: tuple[float, float] = (2, 18), boltzmann: float = 2.0, resolution: float = 0.1, max_rate: float = 35.92, switch: float = 0.01, no_trough: float = 0.01) -> np.ndarray:
    """(f0, voiced probability) of each frame by probabilistic YIN (Mauch and Dixon 2014); 0 where unvoiced.

    Every dip of the normalised difference gets the beta-distributed mass of the thresholds it is the choice of (of several
    dips under a threshold by a truncated Boltzmann prior of their order); the masses are observations of a hidden Markov
    model over pitch bins, voiced and unvoiced, with triangular pitch transitions, decoded by Viterbi.
    """
    parts = frames(np.asarray(x, float), frame, hop)
    shortest, longest = _lags(sr, fmin, fmax, frame)
    norm = _difference(parts, longest)
    per_semitone = int(np.ceil(1 / resolution))
    bins = int(np.floor(12 * per_semitone * np.log2(fmax / fmin))) + 1
    edges = np.linspace(0, 1, thresholds + 1)
    mass = _beta_mass(thresholds, *beta)
    observed = np.zeros((len(parts), bins))
    for t, row in enumerate(norm):
        search = row[shortest - 1 :]
        if len(search) < 3 or np.abs(parts[t]).max() <= 1e-8:
            continue
        dips = np.flatnonzero((search[1:-1] < search[:-2]) & (search[1:-1] <= search[2:])) + 1
        if search[0] < search[1]:
            dips = np.concatenate([[0], dips])
        if not len(dips):
            continue
        under = search[dips][:, None] < edges[None, 1:]
        order = np.cumsum(under, axis=0) - 1
        count = under.sum(axis=0)
        prior = np.where(under, np.exp(-boltzmann * order), 0.0)
        prior = (1 - np.exp(-boltzmann)) / (1 - np.exp(-boltzmann * np.maximum(count, 1))) * prior
        chance = prior @ mass
        chance[search[dips].argmin()] += no_trough * mass[count == 0].sum()
        k = dips + shortest - 1
        bent = _bent(np.broadcast_to(row, (len(k), len(row))), k)
        at = np.rint(12 * per_semitone * np.log2(sr / (k + 1 + bent) / fmin)).astype(int)
        np.add.at(observed[t], np.clip(at, 0, bins - 1), chance)
    voiced = np.clip(observed.sum(axis=1), 0, 1)
    reach = max(1, int(round(max_rate * 12 * hop / sr * per_semitone)))
    best, back = _viterbi(observed, voiced, bins, reach, switch)
    f0 = fmin * 2 ** (best % bins / (12 * per_semitone))
    return np.stack([np.where(best < bins, f0, 0.0), voiced]) if back else np.zeros((2, 0))


def _moved(score: np.ndarray, move: np.ndarray, steps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the best score of a step to it, and the lowest bin that it comes from. Bins that cannot be are left out, if that is less
    work than the neighbours within ``reach``. steps: the chances of all steps, to a bin in its row."""
    bins, rows = len(score), np.arange(len(score))
    known = np.flatnonzero(score > -np.inf)
    if not len(known):
        return score, np.maximum(rows - reach, 0)
    if len(known) <= 2 * reach:
        every = steps + score if len(known) == bins else steps[:, known] + score[known]
        k = every.argmax(axis=1)
        best = every[rows, k]
        return best, np.where(best > -np.inf, known[k], np.maximum(rows - reach, 0))
    every = np.lib.stride_tricks.sliding_window_view(np.pad(score, reach, constant_values=-np.inf), 2 * reach + 1) + move
    k = every.argmax(axis=1)
    return every[rows, k], np.clip(rows + k - reach, 0, bins - 1)


def _viterbi(observed: np.ndarray, voiced: np.ndarray, bins: int, reach: int, switch: float) -> tuple[np.ndarray, bool]:
    """The likeliest states: 0 to bins-1 voiced, the others unvoiced. A step goes up to ``reach`` bins, near ones likelier."""
    n = len(observed)
    if not n:
        return np.zeros(0, int), False
    move = np.log((reach + 1 - np.abs(np.arange(-reach, reach + 1))) / (reach + 1) ** 2)
    side = bins - 1 - reach
    wide = np.pad(move, side, constant_values=-np.inf) if side > 0 else move[-side : len(move) + side]
    steps = np.lib.stride_tricks.sliding_window_view(wide, bins)[::-1]
    with np.errstate(divide="ignore"):
        seen = np.log(np.concatenate([observed, np.repeat((1 - voiced)[:, None] / bins, bins, axis=1)], axis=1))
    stay, change, swapped = np.log(1 - switch), np.log(switch), np.roll(np.arange(2 * bins), bins)
    score = seen[0] - np.log(2 * bins)
    came = np.zeros((n, 2 * bins), np.int32)
    for t in range(1, n):
        moved, source = np.empty(2 * bins), np.empty(2 * bins, int)
        for half in (0, bins):
            moved[half : half + bins], k = _moved(score[half : half + bins], move, steps, reach)
            source[half : half + bins] = half + k
        kept, other = moved + stay, moved[swapped] + change
        came[t] = np.where(kept >= other, source, source[swapped])
        score = np.maximum(kept, other) + seen[t]
    best = np.zeros(n, int)
    best[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        best[t - 1] = came[t, best[t]]
    return best, True


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase along the last axis by a Kaiser (beta 5) low-pass: ceil(n * up / down) samples.

    Outputs of one phase have the same taps, ``down`` inputs apart: a matrix product of strided windows for each phase.
    """
    g = np.gcd(up, down)
    up, down = up // g, down // g
    x = np.asarray(x, float)
    if up == down or not x.shape[-1]:
        return x.copy()
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    kernel *= up / kernel.sum()
    n, many = x.shape[-1], -(-x.shape[-1] * up // down)
    side = half // up + 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(side, side + down)])
    out = np.zeros((*x.shape[:-1], many))
    for phase in range(min(up, many)):
        at = phase * down
        first, last = -(-(at - half) // up), (at + half) // up  # inputs under the kernel
        taps = kernel[at - np.arange(first, last + 1) * up + half]
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(taps), axis=-1)[..., first + side :: down, :]
        out[..., phase::up] = (windows @ taps)[..., : len(range(phase, many, up))]
    return out


def stretch(x: np.ndarray, ratio: tuple[int, int], sr: int | None = None) -> np.ndarray:
    """Resampled by up/down, brought to the old peak, and with a rate to the old loudness."""
    y = resample(x, *ratio)
    top = np.abs(y).max() if len(y) else 0
    y = y * (np.abs(x).max() / top) if top > 0 else y
    return match_loudness(y, x, sr) if sr else y


def match_loudness(x: np.ndarray, like: np.ndarray, sr: int) -> np.ndarray:
    """The signal at another one's loudness; unchanged where one of them is silent."""
    now, wanted = loudness(x, sr), loudness(like, sr)
    return x if SILENT in (now, wanted) else x * 10 ** ((wanted - now) / 20)


def stretch_ratios(limit: int = 20, low: float = 0.7, high: float = 1.3) -> list[tuple[int, int]]:
    """Fractions of numbers below the limit, in order of their values: of equal ones the first found stands last."""
    found = [(x / y, -k, x, y) for k, (x, y) in enumerate((x, y) for x in range(1, limit) for y in range(1, limit)) if x != y and low <= x / y <= high]
    return [(x, y) for _, _, x, y in sorted(found)]


def nearest_ratio(ratios: list[tuple[int, int]], wanted: float) -> tuple[int, int]:
    """The first fraction that is not below the wanted one, else the last."""
    values = [x / y for x, y in ratios]
    return ratios[min(int(np.searchsorted(values, wanted, "left")), len(ratios) - 1)]


def pole_filter(frequency: float, sr: float, amplitude: float = 0.99) -> tuple[tuple, tuple]:
    """An all-pass pair of zeros and poles at an angle: (b, a)."""
    real, square = amplitude * np.cos(2 * np.pi * frequency / sr), amplitude**2
    return (square, -2 * real, 1.0), (1.0, -2 * real, square)


def log_uniform(u: float, low: float, high: float) -> float:
    return float(np.exp(np.log(low) + u * (np.log(high) - np.log(low))))


def butter_one(kind: str, sr: float, freq, gain: float = 1.0) -> tuple[tuple, tuple]:
    """First-order Butterworth: low-pass of a frequency, band-pass of two (bilinear transform)."""
    warp = lambda f: np.tan(np.pi * f / sr)
    if kind == "lowpass":
        w = warp(freq)
        return (w / (1 + w), w / (1 + w)), (1.0, (w - 1) / (1 + w))
    low, high = (warp(f) for f in freq)
    width, square = high - low, low * high
    norm = 1 + width + square
    return (width / norm, 0.0, -width / norm), (1.0, 2 * (square - 1) / norm, (1 - width + square) / norm)


def random_eq(x: np.ndarray, sr: float, u: np.ndarray, p_low: float = 0.75, p_shelf: float = 0.5, p_band: float = 0.5, bands: int = 2) -> np.ndarray:
    """Low-pass, low shelf and bands, each with its probability; ``u``: 5 + 3 * bands uniform numbers.

    Fixed values: low-pass from 80 Hz over 8 octaves, shelf from 40 Hz over 4, bands from 160 Hz over 5, at a rate of 44100.
    """
    scale, top = sr / 44100, 0.499 * sr
    if u[0] < p_low:
        x = iir(x, *butter_one("lowpass", sr, min(80 * 2 ** (8 * u[1]) * scale, top)))
    if u[2] < p_shelf:
        x = x - u[4] ** 0.5 * iir(x, *butter_one("lowpass", sr, min(40 * 2 ** (4 * u[3]) * scale, top)))
    for k in range(bands):
        chance, where, amount = u[5 + 3 * k : 8 + 3 * k]
        if chance < p_band:
            f = 160 * 2 ** (5 * where) * scale
            x = x + (amount**2 * 4 - 1) * iir(x, *butter_one("bandpass", sr, (f * 2 / 3, min(f * 3 / 2, top))))
    return x


def random_distort(x: np.ndarray, sr: float, u: np.ndarray, max_drive: float = 32.0) -> np.ndarray:
    """Equaliser, then tanh of up to ``max_drive`` at full scale, back to the old range, mixed with the dry signal."""
    wet = random_eq(x, sr, u[2:])
    top = np.abs(wet).max() if len(wet) else 0.0
    norm = min(1 / top, 32.0) if top > 0 else 32.0
    drive = 0.25 + u[1] ** 3 * (max_drive - 0.25)
    mix = u[0] ** 2
    return np.tanh(wet * norm * drive) / norm * mix + x * (1 - mix)


def time_stretch(x: np.ndarray, rate: float, n_fft: int = 2048) -> np.ndarray:
    """Faster by ``rate`` at the same pitch: a phase vocoder. round(n / rate) samples."""
    hop = n_fft // 4
    spec = stft(x, n_fft, hop)
    at = np.arange(0, spec.shape[1], rate)
    padded = np.pad(spec, ((0, 0), (0, 2)))
    low, high = padded[:, at.astype(int)], padded[:, at.astype(int) + 1]
    size = np.abs(low) + (at % 1) * (np.abs(high) - np.abs(low))
    advance = 2 * np.pi * hop * np.arange(n_fft // 2 + 1) / n_fft
    change = np.angle(high) - np.angle(low) - advance[:, None]
    step = advance[:, None] + change - 2 * np.pi * np.rint(change / (2 * np.pi))
    phase = np.angle(spec[:, :1]) + np.concatenate([np.zeros((len(step), 1)), np.cumsum(step, axis=1)[:, :-1]], axis=1)
    return istft(size * np.exp(1j * phase), n_fft, hop, int(round(len(x) / rate)))


def pitch_shift(x: np.ndarray, semitones: float, n_fft: int = 2048) -> np.ndarray:
    """Higher by so many semitones at the same length: stretched, then resampled (ratio in thousandths)."""
    rate = 2 ** (semitones / 12)
    y = resample(time_stretch(x, 1 / rate, n_fft), 1000, int(round(1000 * rate)))[: len(x)]
    return np.pad(y, (0, len(x) - len(y)))


#: Absorption of air in dB a metre by octave band (125 Hz to 8 kHz), at 20 degrees and 50 % humidity.
AIR = {125: 0.00044, 250: 0.00131, 500: 0.00273, 1000: 0.00466, 2000: 0.00989, 4000: 0.0297, 8000: 0.105}


def air_absorption(x: np.ndarray, sr: int, metres: float) -> np.ndarray:
    """The loss over a distance, interpolated over frequency, by a zero-phase filter."""
    f = np.fft.rfftfreq(max(2 * len(x), 2), 1 / sr)
    loss = np.interp(f, list(AIR), list(AIR.values())) * metres
    return np.fft.irfft(np.fft.rfft(x, max(2 * len(x), 2)) * 10 ** (-loss / 20))[: len(x)]


def integrator(x: np.ndarray, sr: int) -> np.ndarray:
    alpha = 1 / (1 + 20 * np.pi / sr)
    return iir(x, (alpha**2, -(alpha**2)), (1, -2 * alpha, alpha**2))


def mask_frequencies(x: np.ndarray, low: int, count: int, n_fft: int = 4096) -> np.ndarray:
    spec = stft(x, n_fft, n_fft // 4)
    spec[low : low + count] = 0
    return istft(spec, n_fft, n_fft // 4, len(x))


def follow(level: np.ndarray, sr: float, attack: float, release: float) -> np.ndarray:
    """The volume that follows a level from full scale on: a recursion over samples, for all rows at once; of equal times a filter."""
    up, down = (1 - np.exp(-1 / (t * sr)) for t in (attack, release))
    if up == down:
        return iir(level, (up,), (1.0, up - 1)) + (1 - up) ** np.arange(1, level.shape[-1] + 1)
    out, volume = np.empty_like(level), np.ones(level.shape[:-1])
    for n in range(level.shape[-1]):
        change = level[..., n] - volume
        volume = volume + change * np.where(change > 0, up, down)
        out[..., n] = volume
    return out


def transfer(db: np.ndarray, points: list[tuple[float, float]], knee: float = 6.0) -> np.ndarray:
    """Output level of an input level: lines through the points, levels below the first unchanged but for its gain, and a
    parabola within half a knee of each bend (no further than half way to the next point)."""
    x, y = (np.array(v, float) for v in zip(*points, strict=True))
    x, y = np.concatenate([[x[0] - 1000], x, [x[-1] + 1000]]), np.concatenate([[y[0] - 1000], y, [y[-1] + 1000]])
    out = np.interp(db, x, y)
    slope = np.diff(y) / np.diff(x)
    for k in range(1, len(x) - 1):
        half = min(knee / 2, (x[k] - x[k - 1]) / 2, (x[k + 1] - x[k]) / 2)
        near = np.abs(db - x[k]) < half
        d = db - x[k] + half
        bent = y[k] - half * slope[k - 1] + slope[k - 1] * d + (slope[k] - slope[k - 1]) * d * d / (4 * half)
        out = np.where(near, bent, out)
    return out


def compress(x: np.ndarray, sr: float, threshold_db: float = -40.0, level_db=-20.0, attack: float = 0.1, release: float = 0.1, knee: float = 6.0, limit: bool = True) -> np.ndarray:
    """Compander: levels from -80 dB (unchanged) over the threshold, which becomes ``level_db``, to full scale (unchanged).

    Rows along the first axis, ``level_db`` one number or one a row; a row above full scale is brought to it.
    """
    rows = np.atleast_2d(np.asarray(x, float))
    volume = 20 * np.log10(np.maximum(follow(np.abs(rows), sr, attack, release), 1e-10))
    levels = np.broadcast_to(np.asarray(level_db, float), (len(rows),))
    gain = np.stack([transfer(v, [(-80.0, -80.0), (threshold_db, float(to)), (0.0, 0.0)], knee) - v for v, to in zip(volume, levels, strict=True)]) if len(rows) else volume
    y = rows * 10 ** (gain / 20)
    if limit and y.size:
        y = y / np.maximum(1.0, np.abs(y).max(axis=1, keepdims=True))
    return y.reshape(np.shape(x))


def convolve(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    n = len(x) + len(response) - 1
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response, n), n)[: len(x)]


def coloured_noise(n: int, exponent: float, rng: np.random.Generator) -> np.ndarray:
    """Noise whose power falls as 1/f to the exponent, at a peak of 1."""
    f = np.fft.rfftfreq(max(n, 2))
    spec = (rng.normal(size=len(f)) + 1j * rng.normal(size=len(f))) * np.concatenate([[0], f[1:] ** (-exponent / 2)])
    y = np.fft.irfft(spec, max(n, 2))[:n]
    return y / max(np.abs(y).max(), 1e-12) if n else y
