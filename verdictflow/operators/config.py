"""Role options and the cascade configuration (D2), validated on construction (quirk Q13)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class VerifierSpec:
    """One role's model options; a ModelVerifier's client factory closes over it."""
    model: str
    temperature: float = 0.0
    max_tokens: int = 512
    endpoint: str | None = None
    use_cot: bool = True

    def __post_init__(self):
        if self.temperature < 0:
            raise ValueError("temperatures must be non-negative")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")


@dataclass(frozen=True)
class CascadeConfig:
    """gamma + the three roles (defaults: low / high temperature verifiers, deterministic judge)."""
    verifier_a: VerifierSpec = field(default_factory=lambda: VerifierSpec("verifier-a", 0.1))
    verifier_b: VerifierSpec = field(default_factory=lambda: VerifierSpec("verifier-b", 0.9))
    judge: VerifierSpec = field(default_factory=lambda: VerifierSpec("judge", 0.0))
    gamma: float = 0.7
    policy: str = "p1"

    def __post_init__(self):
        if not 0.0 <= self.gamma <= 1.0:
            raise ValueError("gamma must be between 0 and 1")
        if self.policy not in ("p1", "p2", "p3"):
            raise ValueError("policy must be p1, p2 or p3")

    def with_gamma(self, gamma: float) -> "CascadeConfig":
        """Overrides are validated too (the reference's CLI override skipped the check)."""
        return CascadeConfig(self.verifier_a, self.verifier_b, self.judge, gamma, self.policy)

    def roster(self, spark: SparkSession) -> DataFrame:
        """The roles as a small DataFrame (for joining to results or comparing configurations)."""
        rows = [(role, *asdict(spec).values()) for role, spec in
                (("a", self.verifier_a), ("b", self.verifier_b), ("judge", self.judge))]
        return spark.createDataFrame(rows, "role string, model string, temperature double, max_tokens int, "
                                           "endpoint string, use_cot boolean")
