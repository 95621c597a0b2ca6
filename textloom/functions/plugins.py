"""Places for what stands outside the engine, each with an offline stand-in that gives the same answer each time."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import resource
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import code_text
from textloom.session import ship


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...


class Encoder(Protocol):
    def encode(self, text: str) -> list[int]: ...


class SyntaxChecker(Protocol):
    def check(self, text: str, name: str | None) -> tuple[bool, list[str], str | None]:
        """Whether the text is valid, which modules it instantiates, and what is wrong."""


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class Simulator(Protocol):
    def run(self, prompt: str, completion: str, test: str) -> tuple[str, str, bool]:
        """stdout, stderr, and whether it took too long."""


class CharTokenizer:
    def count(self, text: str) -> int:
        return -(-len(text) // 4)


class ByteTokenizer:
    """The offline stand-in for a tokenizer's ids: 3 and up, one for each byte in UTF-8."""

    def encode(self, text: str) -> list[int]:
        return [b + 3 for b in text.encode()]


class TiktokenTokenizer:
    """Counts by a rank file; the file's path is a parameter."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._enc = path, pattern, None

    def count(self, text: str) -> int:
        if self._enc is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._enc.encode_ordinary(text))


class StructureChecker:
    """Balanced modules, blocks and brackets, and the declared name. With ``strict`` a module that instantiates others is refused."""

    def __init__(self, strict: bool = False):
        self.strict = strict

    def check(self, text: str, name: str | None) -> tuple[bool, list[str], str | None]:
        code = re.sub(r'"(?:\\.|[^"\\])*"', '""', code_text.cut_comments(text))
        words = re.findall(r"[A-Za-z_$][\w$]*", code)
        for opens, closes in (("module", "endmodule"), ("begin", "end"), ("function", "endfunction"), ("task", "endtask"), ("generate", "endgenerate")):
            if words.count(opens) != words.count(closes):
                return False, [], f"{opens} and {closes} don't match"
        if sum(words.count(w) for w in ("case", "casez", "casex")) != words.count("endcase"):
            return False, [], "case and endcase don't match"
        stack = []
        for c in code:
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and (not stack or stack.pop() + c not in ("()", "[]", "{}")):
                return False, [], "brackets don't match"
        if stack:
            return False, [], "brackets don't match"
        if "module" not in words:
            return False, [], "no module"
        if name is not None and words[words.index("module") + 1 :][:1] != [name]:
            return False, [], "the module has another name"
        found = code_text.instances(code)
        if self.strict and found:
            return False, found, "it instantiates other modules"
        return True, found, None


class EchoCompleter:
    """Answers with a digest of the prompt."""

    def complete(self, prompt: str) -> str:
        return "summary: " + hashlib.sha256(prompt.encode()).hexdigest()[:16]


class RuledCompleter:
    """Answers by a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def complete(self, prompt: str) -> str:
        return self.rule(prompt)


class HashEmbedder:
    """A vector of hashed words, so that texts with common words are near."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.size
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % self.size] += 1.0 if h >> 63 else -1.0
        return v


class RecordedSimulator:
    """Runs that were recorded: a map from completion to (stdout, stderr, timed_out)."""

    def __init__(self, runs: dict[str, tuple[str, str, bool]]):
        self.runs = runs

    def run(self, prompt: str, completion: str, test: str) -> tuple[str, str, bool]:
        return self.runs.get(completion, ("", "no record", False))


def _column(f: Callable, returns: str):
    @F.pandas_udf(returns)
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    ship()
    return run


def token_ids(encoder: Encoder, text: Column) -> Column:
    """All ids of each text; none for null."""
    return F.coalesce(_column(encoder.encode, "array<int>")(text), F.array().cast("array<int>"))


def token_count(tokenizer: Tokenizer, text: Column) -> Column:
    return _column(tokenizer.count, "bigint")(text)


def completed(completer: Completer, prompt: Column) -> Column:
    return _column(completer.complete, "string")(prompt)


def embedded(embedder: Embedder, text: Column) -> Column:
    return _column(embedder.embed, "array<double>")(text)


def json_text(reply: str) -> str | None:
    """The widest braces of a reply, with Python's literals repaired, if that is JSON of one object."""
    import json

    for word, known in (("null", '""'), ("False", "false"), ("True", "true")):
        reply = reply.replace(word, known)
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        return found[0] if found and isinstance(json.loads(found[0], strict=False), dict) else None
    except ValueError:
        return None


def parsed_with_fallback(prompt: Column, schema: str, cheap: Completer, fixer: Completer, strong: Completer, instructions: str) -> Column:
    """The first reply that parses: of the cheap model, of the fixer on that reply, of the strong model. A model is asked only where those before it failed."""
    from textloom.operators.pairs import repair_request

    def ask(text: str) -> str | None:
        first = cheap.complete(text)
        return json_text(first) or json_text(fixer.complete(repair_request(instructions, first))) or json_text(strong.complete(text))

    return F.from_json(_column(ask, "string")(prompt), schema, {"allowUnquotedControlChars": "true"})


class RetryingCompleter:
    """Asks again after an error, up to ``tries`` times in all, and waits longer each time; the last error goes through."""

    def __init__(self, completer: Completer, tries: int = 3, wait: float = 1.0):
        self.completer, self.tries, self.wait = completer, tries, wait

    def complete(self, prompt: str) -> str:
        for k in range(self.tries):
            try:
                return self.completer.complete(prompt)
            except Exception:  # whatever a remote service raises
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)
        raise ValueError("no tries")


class Chain:
    """A template with named places and a model: a completer of whole rows."""

    def __init__(self, template: str, completer: Completer):
        self.template, self.completer = template, completer

    def run(self, rows: DataFrame, reply: str = "reply") -> DataFrame:
        """Adds the model's reply to the template filled from each row's columns; a missing value is empty."""
        text, places = F.lit(self.template), re.findall(r"\{(\w+)\}", self.template)
        parts = re.split(r"\{\w+\}", self.template)
        text = F.concat(*[x for part, place in zip(parts, [*places, None], strict=True) for x in (F.lit(part), *([F.coalesce(F.col(place).cast("string"), F.lit(""))] if place else []))])
        return rows.withColumn(reply, completed(self.completer, text))


class ProcessSimulator:
    """Compiles and runs a sample with commands of one's own, in a folder that lives as long as the run.

    ``compile_`` and ``run_`` are argument lists in which {source} and {binary} stand for the files. A run that takes more than ``seconds`` or more than
    ``megabytes`` of memory is stopped with all it started; it gets no input, no environment but PATH, and may write ``megabytes`` to a file at most.
    """

    def __init__(self, compile_: list[str] | None, run_: list[str], suffix: str = ".sv", seconds: float = 30.0, megabytes: int = 1024):
        self.compile_, self.run_, self.suffix, self.seconds, self.megabytes = compile_, run_, suffix, seconds, megabytes

    def _guard(self) -> None:
        size = self.megabytes << 20
        for limit, value in ((resource.RLIMIT_AS, size), (resource.RLIMIT_FSIZE, size), (resource.RLIMIT_CORE, 0), (resource.RLIMIT_CPU, int(self.seconds) + 1)):
            resource.setrlimit(limit, (value, value))

    def _call(self, command: list[str], folder: str, seconds: float) -> tuple[str, str, bool, int]:
        process = subprocess.Popen(command, cwd=folder, env={"PATH": os.environ.get("PATH", "")}, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, preexec_fn=self._guard)
        late = False
        try:
            out, err = process.communicate(timeout=seconds)
        except subprocess.TimeoutExpired:
            late = True
        if late or process.returncode:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(process.pid, signal.SIGKILL)  # what it started goes with it
        if late:
            out, err = process.communicate()
        return out.decode("utf-8", "replace"), err.decode("utf-8", "replace"), late, process.returncode

    def run(self, prompt: str, completion: str, test: str) -> tuple[str, str, bool]:
        with tempfile.TemporaryDirectory(prefix="run-") as folder:
            source, binary = (os.path.join(folder, x) for x in (f"sample{self.suffix}", "sample.bin"))
            with open(source, "w", encoding="utf-8") as f:
                f.write("\n".join((test or "", prompt or "", completion or "")))
            began = time.monotonic()
            for command in filter(None, (self.compile_, self.run_)):
                out, err, late, code = self._call([x.format(source=source, binary=binary) for x in command], folder, self.seconds - (time.monotonic() - began))
                if late or err or code:
                    return out, err or ("" if late else f"exit status {code}"), late
            return out, err, False


def checked(rows: DataFrame, checker: SyntaxChecker, text: str = "text", name: str | None = "module_name") -> DataFrame:
    """Adds ok, module_inst_list and error."""
    ship(rows.sparkSession)

    @F.pandas_udf("ok boolean, module_inst_list array<string>, error string")
    def run(texts, names):
        import pandas as pd

        got = [(False, [], "no text") if t is None else checker.check(t, n) for t, n in zip(texts, names, strict=True)]
        return pd.DataFrame(got, columns=["ok", "module_inst_list", "error"])

    n = F.col(name) if name else F.lit(None).cast("string")
    return rows.withColumn("__c", run(F.col(text), n)).select(*rows.columns, "__c.ok", "__c.module_inst_list", "__c.error")


def first_valid(rows: DataFrame, completer: Completer, checker: SyntaxChecker, prompt: str = "prompt", trials: int = 10) -> DataFrame:
    """Completions tried until one is valid, at most ``trials`` times: adds completion (null if none was), attempts."""
    ship(rows.sparkSession)

    @F.pandas_udf("completion string, attempts int")
    def run(prompts):
        import pandas as pd

        out = []
        for p in prompts:
            got, n = None, 0
            while p is not None and got is None and n < trials:
                n += 1
                c = completer.complete(f"{p}\n# trial {n}" if n > 1 else p)
                got = c if checker.check(c, None)[0] else None
            out.append((got, n))
        return pd.DataFrame(out, columns=["completion", "attempts"])

    return rows.withColumn("__r", run(F.col(prompt))).select(*rows.columns, "__r.completion", "__r.attempts")


def simulated(samples: DataFrame, simulator: Simulator) -> DataFrame:
    """Adds stdout, stderr and timed_out to samples joined with their problems."""
    ship(samples.sparkSession)

    @F.pandas_udf("stdout string, stderr string, timed_out boolean")
    def run(prompts, completions, tests):
        import pandas as pd

        return pd.DataFrame([simulator.run(*x) for x in zip(prompts, completions, tests, strict=True)], columns=["stdout", "stderr", "timed_out"])

    return samples.withColumn("__s", run("prompt", "completion", "test")).select(*samples.columns, "__s.stdout", "__s.stderr", "__s.timed_out")
