"""What a pipeline should do, apart from what it does: a desired state that is changed by compare-and-swap, and convergence."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fluxloom.errors import Coded
from fluxloom.manifest import Manifest
from fluxloom.streaming.runtime import Pipeline

DESIRED = ("RUNNING", "PAUSED", "STOPPED")
#: Times a change is tried again when somebody else changed the state in between (fixed value).
RETRIES = 8


class Control:
    """The desired state of a pipeline under a folder, with an epoch that every change raises."""

    def __init__(self, spark: SparkSession, path: str):
        self.manifest = Manifest(spark, path)

    def read(self) -> tuple[str, int]:
        """Desired state and epoch; STOPPED and 0 before anything was asked for."""
        _, state = self.manifest.load()
        return state.get("desired", "STOPPED"), state.get("epoch", 0)

    def ask(self, desired: str, epoch: int | None = None) -> int:
        """Ask for a state; the new epoch.  With ``epoch`` only if nobody has changed it since; without, tried again."""
        if desired not in DESIRED:
            raise Coded("dsl.illegal-value", value=desired, expected=", ".join(DESIRED), path="desired")
        for _ in range(RETRIES):
            held, state = self.manifest.load()
            if epoch is not None and state.get("epoch", 0) != epoch:
                raise Coded("lifecycle.illegal-transition", verb=f"ask {desired}", state=f"epoch {state.get('epoch', 0)}")
            try:
                self.manifest.commit(held, {**state, "desired": desired, "epoch": state.get("epoch", 0) + 1})
                return state.get("epoch", 0) + 1
            except RuntimeError:  # somebody was faster
                continue
        raise Coded("lifecycle.illegal-transition", verb=f"ask {desired}", state="changed by others all the time")


def converge(p: Pipeline, control: Control, follow: bool = True) -> str:
    """Take the step that brings a pipeline nearer to what is asked for; its state after it.

    A failure is sticky: a failed pipeline is only ever stopped.  A run that has completed is not started again.
    """
    desired, _ = control.read()
    state = p.status().state
    if desired == "RUNNING" and state in ("NEW", "STOPPED"):
        p.start(follow)
    elif desired == "RUNNING" and state == "PAUSED":
        p.resume(follow)
    elif desired == "PAUSED" and state == "RUNNING":
        p.pause()
    elif desired == "STOPPED" and state in ("RUNNING", "PAUSED", "FAILED"):
        p.stop()
    return p.status().state
