"""Keyed state for streams: sentences out of tokens, utterances out of audio, rates out of byte counts.

Reading a row and calling the state cost far more than the work on a value. So rows come packed, many of a
key in one with an array per column, and the state or the timers are asked only where something can be there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuewright.functions.sentences import Release, flush, push

TICK_MS, SILENCE_MS, ENOUGH_BYTES = 2000, 3000, 64_000
RATE_WINDOW_MS, EMIT_EVERY_MS = 8000, 300
IDLE_MS = 30_000


def _in_order(packs: list[Row], columns: list[str], by: int) -> list[tuple]:
    """The named columns of all rows in the packs, in the order of the first ``by`` of them; nulls last."""
    rows = [r for pack in packs for r in zip(*[pack[c] for c in columns])]
    return sorted(rows, key=lambda r: [(v is None, v) for v in r[:by]])


def _latest_ms(packs: list[Row]) -> int:
    return int(max(p["ts"] for p in packs if p["ts"] is not None).timestamp() * 1000)


def _timer_at(handle: StatefulProcessorHandle, at_ms: int | None, standing: bool = True) -> None:
    """Let one timer stand, or none; ``standing`` says whether an earlier one may be there."""
    if standing:
        for timer in list(handle.listTimers()):
            handle.deleteTimer(timer)
    if at_ms is not None:
        handle.registerTimer(at_ms)


class Sentences(StatefulProcessor):
    """Tokens (token_no, token, is_last) of a session to sentences.

    A session that stops without a last token is flushed by an event-time timer.
    """

    def __init__(self, rules: Release, idle_ms: int = 30_000):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "buffer string, first boolean, sentence_no long")

    def _out(self, key, number: int, sentences: list[str]) -> Iterator[Row]:
        made = Row("session", "sentence_no", "sentence")
        for i, sentence in enumerate(sentences, number + 1):
            yield made(key[0], i, sentence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        buffer, first, number = self.state.get() or ("", True, 0)
        waited = bool(buffer)
        out: list[str] = []
        packs = list(rows)
        for _, token, last in _in_order(packs, ["token_no", "token", "is_last"], 1):
            done, buffer, first = push(buffer, first, token, self.rules)
            out += done
            if last:
                out += flush(buffer)
                buffer, first = "", True
        self.state.update((buffer, first, number + len(out)))
        _timer_at(self.handle, _latest_ms(packs) + self.idle_ms if buffer else None, waited)
        yield from self._out(key, number, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        buffer, _, number = self.state.get() or ("", True, 0)
        out = flush(buffer)
        self.state.update(("", True, number + len(out)))
        yield from self._out(key, number, out)

    def close(self) -> None:
        pass


def next_tick(start: int, after: int) -> int:
    """First check of the grid ``start + k * TICK_MS`` later than ``after``."""
    return start + ((after - start) // TICK_MS + 1) * TICK_MS


def ticks_between(start: int, after: int, upto: int) -> int:
    """Checks later than ``after`` and no later than ``upto``."""
    return max(0, (upto - start) // TICK_MS - (after - start) // TICK_MS)


class Utterances(StatefulProcessor):
    """Audio bursts (at_ms, bytes, kind) of a session to utterances closed by silence.

    Checks run every two seconds of the session's clock. A check more than three seconds after
    the last audio, pause or resume closes the utterance if enough bytes were buffered; other
    checks with enough bytes count as partial results; none run while paused. Between two rows
    nothing changes, so checks are counted, not stepped through.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "start long, last long, seen long, total long, partials long, paused boolean")

    def _advance(self, s: tuple, now: int) -> tuple[tuple, tuple | None]:
        """State after all checks before ``now``, and the utterance one of them closed."""
        start, last, seen, total, partials, paused = s
        if paused or total < ENOUGH_BYTES:
            return (start, last, max(seen, now - 1), total, partials, paused), None
        close = next_tick(start, max(last + SILENCE_MS, seen))
        if total > ENOUGH_BYTES and close < now:
            partials += ticks_between(start, seen, close - 1)
            return None, (start, last, close, total, partials)
        partials += ticks_between(start, seen, now - 1)
        return (start, last, max(seen, now - 1), total, partials, paused), None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.state.get()
        known = s is not None
        closed = []
        for at, _, size, kind in _in_order(list(rows), ["at_ms", "row_no", "bytes", "kind"], 2):
            if s is not None:
                s, done = self._advance(s, at)
                closed += [done] if done else []
            if s is None:
                s = (at, at, at, 0, 0, False)
            start, _, seen, total, partials, paused = s
            paused = kind == "pause" or (paused and kind != "resume")
            s = (start, at, seen, total + (size if kind == "audio" else 0), partials, paused)
        self._keep(s, known)
        yield from self._out(key, closed)

    def _keep(self, s: tuple | None, known: bool) -> None:
        if s is None:
            _timer_at(self.handle, None, known)
            self.state.clear()
            return
        self.state.update(s)
        checked = s[3] > ENOUGH_BYTES and not s[5]
        _timer_at(self.handle, next_tick(s[0], max(s[1] + SILENCE_MS, s[2])) if checked else None, known)

    def _out(self, key, closed: list[tuple]) -> Iterator[Row]:
        made = Row("session", "start_ms", "last_audio_ms", "closed_ms", "bytes", "partials")
        for utterance in closed:
            yield made(key[0], *utterance)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self.state.get()
        if s is None:
            return
        s, done = self._advance(s, int(expiredTimerInfo.getExpiryTimeInMs()) + 1)
        self._keep(s, True)
        yield from self._out(key, [done] if done else [])

    def close(self) -> None:
        pass


class RollingRates(StatefulProcessor):
    """Byte samples (at_ms, sample_no, bytes_done, total_bytes) of a download to its rate over the trailing window.

    The state holds the samples of one window; rates are given at least 0.3 s apart. It is removed when
    the download is complete, or when it has been idle for ``idle_ms`` of event time.
    """

    def __init__(self, window_ms: int = RATE_WINDOW_MS, every_ms: int = EMIT_EVERY_MS, idle_ms: int = IDLE_MS):
        self.window_ms, self.every_ms, self.idle_ms = window_ms, every_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "at_ms long, bytes_done long")
        self.emitted = handle.getValueState("emitted", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        emitted = self.emitted.get()
        last = emitted[0] if emitted else None
        # The first sample is always given, so no samples are held before one was.
        held = deque(tuple(s) for s in self.samples.get()) if emitted else deque()
        made = Row("job_id", "at_ms", "sample_no", "bytes_done", "rate")
        out, complete = [], False
        for at, number, done, total in _in_order(list(rows), ["at_ms", "sample_no", "bytes_done", "total_bytes"], 2):
            held.append((at, done))
            while held[0][0] < at - self.window_ms:
                held.popleft()
            if last is None or at - last >= self.every_ms:
                (t0, b0), (t1, b1) = held[0], held[-1]
                out.append(made(key[0], at, number, done, (b1 - b0) * 1000.0 / (t1 - t0) if t1 > t0 else 0.0))
                last = at
            complete = total is not None and done >= total
        if not complete:
            self.samples.put(list(held))
            self.emitted.update((last,))
            _timer_at(self.handle, held[-1][0] + self.idle_ms, emitted is not None)
        elif emitted:
            self._forget()
        yield from out

    def _forget(self) -> None:
        _timer_at(self.handle, None)
        self.samples.clear()
        self.emitted.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._forget()
        yield from ()

    def close(self) -> None:
        pass


class Replay(StatefulProcessor):
    """Events (ts, seq, event_id, kind) of a job past a sequence number, up to the one that ends it.

    After the end only a mark is kept, and that for ``idle_ms`` of event time; jobs without an end keep
    nothing.
    """

    def __init__(self, after_seq: int, terminal: tuple[str, ...], idle_ms: int = IDLE_MS):
        self.after_seq, self.terminal, self.idle_ms = after_seq, terminal, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        packs = list(rows)
        events = _in_order(packs, ["seq", "event_id", "kind"], 1)
        ended = self.ended.get()
        end = ended[0] if ended else next((seq for seq, _, kind in events if kind in self.terminal), None)
        if ended is None and end is not None:
            self.ended.update((end,))
            _timer_at(self.handle, _latest_ms(packs) + self.idle_ms, False)
        made = Row("job_id", "seq", "event_id", "kind")
        for seq, event, kind in events:
            if seq > self.after_seq and (end is None or seq <= end):
                yield made(key[0], seq, event, kind)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.ended.clear()
        yield from ()

    def close(self) -> None:
        pass


def earliest(firsts: dict[str, tuple], rows: pd.DataFrame, sent: set[str], most: int) -> dict[str, tuple]:
    """The ``most`` fingerprints that occur first, with their first (created_at, event_id).

    What is pruned cannot return but with an earlier time, which then is its first.
    """
    for name, at, event in rows[["fingerprint", "created_at", "event_id"]].itertuples(index=False):
        if name not in sent and (name not in firsts or (at, event) < firsts[name]):
            firsts[name] = (at, event)
    ranked = sorted(firsts.items(), key=lambda x: (x[1], x[0]))[:most]
    return dict(ranked)


class FirstErrors(StatefulProcessor):
    """Errors (fingerprint, created_at, event_id) of a session to the first of each fingerprint, ``cap`` at most.

    The state holds the fingerprints sent, never more than ``cap``, and goes when the watermark has passed
    the session's last error by ``keep_ms``.
    """

    def __init__(self, cap: int, keep_ms: int):
        self.cap, self.keep_ms = cap, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", "fingerprint string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sent = {r[0] for r in self.sent.get()} if self.sent.exists() else set()
        firsts: dict[str, tuple] = {}
        newest = None
        for part in rows:
            firsts = earliest(firsts, part, sent, self.cap - len(sent))
            newest = part["created_at"].max() if newest is None else max(newest, part["created_at"].max())
        if firsts:
            self.sent.put([(name,) for name in [*sent, *firsts]])
        _timer_at(self.handle, int(newest.timestamp() * 1000) + self.keep_ms)
        yield self._out(key, firsts)

    def _out(self, key, firsts: dict[str, tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], name, *f) for name, f in firsts.items()], columns=["session", "fingerprint", "created_at", "event_id"])
        return out.astype({"session": "int64", "fingerprint": "object", "created_at": "datetime64[ns]", "event_id": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        yield self._out(key, {})

    def close(self) -> None:
        pass
