"""The gate between the engine and a text model: nothing goes in or comes out that the secret policy has not seen."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import secrets
from spandrel.operators import generate

FIELDS = ("system", "prompt")


@dataclass(frozen=True)
class Gate:
    """Approves envelopes, calls the model, approves what it says.

    policy: redact, warn or strict. on_event gets a table of what was found (stage, key, action, kind, count), never a
    value; what it raises is swallowed.
    """

    policy: str = "redact"
    on_event: Callable[[DataFrame], None] | None = None

    def approve_input(self, envelopes: DataFrame, key: str = "key") -> DataFrame:
        """key, system, prompt, action, findings: both fields after the policy, with one numbering of placeholders."""
        return secrets.approve_envelope(envelopes, FIELDS, self.policy, key)

    def approve_output(self, answers: DataFrame, column: str = "content") -> DataFrame:
        """answers with the text after the policy, and action and findings."""
        return secrets.apply_policy(answers, column, self.policy)

    def generate(self, envelopes: DataFrame, model: Callable[[str], str], key: str = "key") -> DataFrame:
        """key, content, action, findings of rows (key, system, prompt). Strict fails before the model is called."""
        allowed = self.approve_input(envelopes, key)
        prompts = allowed.select(F.col(key).alias("key"), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in FIELDS)).alias("prompt"))
        out = self.approve_output(generate.generate(prompts, model)).withColumnRenamed("key", key)
        self._tell(events(allowed, key, "input").union(events(out, key, "output")))
        return out

    def stream(self, system: str, prompt: str, model: Callable[[str], Iterable[str]], deliver: Callable[[str], None]) -> str:
        """One answer that comes in pieces: it is delivered once, whole, after it was approved."""
        asked = self.approve_text("\n\n".join(x for x in (system, prompt) if x))
        answer = self.approve_text("".join(model(asked)))
        deliver(answer)
        return answer

    def approve_text(self, value: str) -> str:
        """A single text after the policy; strict raises where something is found."""
        new, found = secrets.redact(value)
        if found and self.policy == "strict":
            raise ValueError("a secret was found")
        return new if self.policy == "redact" else value

    def _tell(self, found: DataFrame) -> None:
        if self.on_event is None:
            return
        try:
            self.on_event(found)
        except Exception as error:  # an observer must not stop what it observes
            logging.getLogger("spandrel").warning("an observer failed: %s", type(error).__name__)


def events(approved: DataFrame, key: str, stage: str) -> DataFrame:
    """stage, key, action, kind, count of what was found; kind is null where nothing was."""
    return approved.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), "action", F.explode_outer("findings").alias("f")).select("stage", "key", "action", "f.kind", "f.count")
