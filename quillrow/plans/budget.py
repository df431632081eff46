"""One budget of calls in flight for a whole run, whatever its partitions.

The driver hands out leases; a task asks for one for each call that waits and
gives it back after, so the tasks that really run share the budget and a single
task may hold all of it.  A lease is bound to its task's connection: when a task
or an executor dies, the connection ends and its leases return.  A service that
asks to be left alone for a while is left alone by all tasks.
"""

from __future__ import annotations

import asyncio
import contextvars
import json
import secrets
import threading
import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Seconds for which a task passes a lease on among its own calls before others get a turn.
SLICE = 0.05
#: Seconds over which a task looks whether its calls wait, before it asks for more leases.
WATCH = 0.004
#: The gate of the task whose step is running, for steps that want all tasks to pause.
current_gate: contextvars.ContextVar[Gate | None] = contextvars.ContextVar("gate", default=None)


@dataclass(frozen=True)
class Budget:
    """Where leases are had, for which run, and how many there are."""

    host: str
    port: int
    secret: str
    run: str
    limit: int


class _Pool:
    """The leases of one run."""

    def __init__(self, limit: int):
        self.free = limit
        self.waiting: deque[_Task] = deque()
        self.tasks: set[_Task] = set()
        self.not_before = 0.0

    def grant(self) -> None:
        while self.free and self.waiting and time.monotonic() >= self.not_before:
            task = self.waiting.popleft()
            self.free -= 1
            task.held += 1
            task.writer.write(b"go\n")

    def pause(self, seconds: float) -> None:
        until = time.monotonic() + seconds
        if until > self.not_before:
            self.not_before = until
            for task in self.tasks:
                task.writer.write(b"hold %f\n" % seconds)
            asyncio.get_running_loop().call_later(seconds + 0.001, self.grant)

    def leave(self, task: _Task) -> None:
        self.tasks.discard(task)
        self.drop(task)
        self.free += task.held
        self.grant()

    def drop(self, task: _Task) -> None:
        self.waiting = deque(t for t in self.waiting if t is not task)


class _Task:
    def __init__(self, writer: asyncio.StreamWriter):
        self.writer, self.held = writer, 0


class BudgetService:
    """The driver's side: one thread for all runs of the process."""

    _one: BudgetService | None = None
    _lock = threading.Lock()

    def __init__(self, host: str, port: int = 0):
        self.host, self.secret, self.pools = host, secrets.token_hex(16), {}
        self.loop = asyncio.new_event_loop()
        self.port = 0
        ready = threading.Event()
        threading.Thread(target=self._serve, args=(port, ready), daemon=True, name="quillrow-budget").start()
        ready.wait()
        if not self.port:
            raise OSError(f"the driver can't listen at {host}:{port} for the tasks' calls")

    @classmethod
    def of(cls, spark: SparkSession) -> BudgetService:
        """The process's service, at the address by which executors know the driver and at ``spark.quillrow.budget.port`` if that is set."""
        with cls._lock:
            if cls._one is None:
                host = spark.conf.get("spark.driver.host", "127.0.0.1")
                cls._one = cls(host, int(spark.conf.get("spark.quillrow.budget.port", "0")))
            return cls._one

    def budget(self, run: str, limit: int) -> Budget:
        return Budget(self.host, self.port, self.secret, run, limit)

    def _serve(self, port: int, ready: threading.Event) -> None:
        async def start() -> None:
            try:
                server = await asyncio.start_server(self._task, self.host, port)
            except OSError:
                server = await asyncio.start_server(self._task, None, port)  # the name executors know may not be an own address
            self.port = server.sockets[0].getsockname()[1]

        asyncio.set_event_loop(self.loop)
        try:
            self.loop.run_until_complete(start())
        finally:
            ready.set()
        self.loop.run_forever()

    async def _task(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        try:
            hello = json.loads(await reader.readline())
            if not secrets.compare_digest(str(hello.get("secret")), self.secret):
                return
            pool = self.pools.setdefault(hello["run"], _Pool(int(hello["limit"])))
        except (ValueError, KeyError, OSError):
            writer.close()
            return
        task = _Task(writer)
        pool.tasks.add(task)
        try:
            while line := await reader.readline():
                word, _, rest = line.decode().strip().partition(" ")
                if word == "take":
                    pool.waiting.append(task)
                elif word == "give":
                    task.held -= 1
                    pool.free += 1
                elif word == "hold":
                    pool.pause(float(rest))
                elif word == "drop":
                    pool.drop(task)
                    writer.write(b"done\n")
                pool.grant()
        except OSError:
            pass  # the task is gone
        finally:
            pool.leave(task)
            if not pool.tasks:
                self.pools.pop(hello["run"], None)
            writer.close()


class Gate:
    """A task's side: ``take`` a lease before a call, ``give`` it after, ``settle`` when no call is left for now.

    Calls that never wait need one lease, one after the other, and leave the
    rest to other tasks; a task asks for more only while its calls wait.
    """

    def __init__(self, budget: Budget):
        self.budget = budget
        self.waiters: deque[asyncio.Future] = deque()
        self.asked = 0
        self.held = 0
        #: Leases at hand between the calls of a task that is still starting some, each with the time since when.
        self.spare: list[float] = []
        self.keeping = False
        #: Leases that the task may hold or ask for; grows while its calls leave the processor idle.
        self.wanted = 1
        self.watch: asyncio.TimerHandle | None = None
        self.not_before = 0.0
        self.writer: asyncio.StreamWriter | None = None
        self.settled: asyncio.Future | None = None

    async def open(self) -> None:
        try:
            reader, self.writer = await asyncio.open_connection(self.budget.host, self.budget.port)
        except OSError as problem:
            raise ConnectionError(f"the driver's call budget can't be reached at {self.budget.host}:{self.budget.port}: {problem}") from problem
        self._say(json.dumps({"secret": self.budget.secret, "run": self.budget.run, "limit": self.budget.limit}))
        self.listener = asyncio.ensure_future(self._listen(reader))

    def _say(self, word: str) -> None:
        self.writer.write(word.encode() + b"\n")

    async def _listen(self, reader: asyncio.StreamReader) -> None:
        while line := await reader.readline():
            word, _, rest = line.decode().strip().partition(" ")
            if word == "go":
                self.asked -= 1
                self.held += 1
                self._pass_on(time.monotonic())
            elif word == "hold":
                self.not_before = max(self.not_before, time.monotonic() + float(rest))
            elif word == "done" and self.settled:
                self.settled.set_result(None)
        lost = ConnectionError("the driver's call budget went away")
        for waiter in [*self.waiters, *([self.settled] if self.settled else [])]:
            if not waiter.done():
                waiter.set_exception(lost)

    def _pass_on(self, since: float) -> None:
        """A lease for the next that waits, or back."""
        while self.waiters:
            waiter = self.waiters.popleft()
            if not waiter.done():
                waiter.set_result(since)
                return
        self._back()

    def _back(self) -> None:
        self.held -= 1
        self._say("give")

    def _ask(self) -> None:
        while self.asked < min(len(self.waiters), self.budget.limit) and self.asked + self.held < self.wanted:
            self.asked += 1
            self._say("take")
        if self.waiters and self.wanted < self.budget.limit and self.watch is None:
            self.watch = asyncio.get_running_loop().call_later(WATCH, self._grow, time.monotonic(), time.process_time())

    def _grow(self, began: float, used: float) -> None:
        """Twice as many leases, if the calls have waited for most of the time since."""
        self.watch = None
        if self.held and time.process_time() - used < (time.monotonic() - began) / 2:
            self.wanted = min(2 * self.wanted, self.budget.limit)
        self._ask()

    async def take(self) -> float:
        """Waits for a lease; its value goes to ``give``."""
        if self.spare:
            return self.spare.pop()
        waiter = asyncio.get_running_loop().create_future()
        self.waiters.append(waiter)
        self._ask()
        return await waiter

    def give(self, since: float) -> None:
        now = time.monotonic()
        if now - since >= SLICE or now < self.not_before:
            self._back()
            self._ask()
        elif self.keeping and not self.waiters:
            self.spare.append(since)
        else:
            self._pass_on(since)

    async def ready(self) -> None:
        """Before a task starts one more call: a lease at hand, unless calls under way have those there are."""
        self.keeping = True
        if not self.held and not self.waiters:
            self.spare.append(await self.take())

    def started(self) -> None:
        """No more calls are to start for now."""
        self.keeping = False
        while self.spare:
            self.spare.pop()
            self._back()

    def pause(self, seconds: float) -> None:
        """No task begins a call for so long."""
        self.not_before = max(self.not_before, time.monotonic() + seconds)
        while self.spare:
            self.spare.pop()
            self._back()
        self._say(f"hold {seconds:f}")

    async def settle(self) -> None:
        """Takes back what was asked for, so that no lease is on its way to a task that doesn't listen."""
        self.started()
        if self.watch:
            self.watch.cancel()
            self.watch = None
        self.settled = asyncio.get_running_loop().create_future()
        self._say("drop")
        await self.settled
        self.settled, self.asked = None, 0

    def close(self) -> None:
        self.listener.cancel()
        self.writer.close()
