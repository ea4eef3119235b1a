"""In-process model clients for ModelVerifier (tests, demos, benchmarks).

A real deployment passes a factory for its own HTTP/SDK client; these stand-ins
answer from the claim text so the whole UDF path (batching, retries, timeouts,
error isolation, call counting) can be exercised without a model server.
"""

from __future__ import annotations

import time

import pandas as pd


class RuleClient:
    """Answers 'yes' for claims of even length, 'no' otherwise, with a fixed confidence.

    ``fail_on`` / ``slow_on``: a batch containing that substring raises / sleeps ``delay_s``.
    """

    def __init__(self, confidence: str = "0.95", fail_on: str | None = None, slow_on: str | None = None,
                 delay_s: float = 3.0, log_path: str | None = None):
        self.log_path = log_path  # appends one line per claim received (to check who was asked)
        self.confidence = confidence
        self.fail_on = fail_on
        self.slow_on = slow_on
        self.delay_s = delay_s

    def __call__(self, claims: pd.Series) -> pd.DataFrame:
        if self.fail_on and claims.str.contains(self.fail_on, regex=False).any():
            raise RuntimeError("model crashed")
        if self.slow_on and claims.str.contains(self.slow_on, regex=False).any():
            time.sleep(self.delay_s)
        n = len(claims)
        if self.log_path:
            with open(self.log_path, "a") as f:
                f.writelines(f"{c}\n" for c in claims)
        return pd.DataFrame({"verdict": ["yes" if len(c) % 2 == 0 else "no" for c in claims],
                             "confidence": [self.confidence] * n, "reasoning": ["checked by rule"] * n})
