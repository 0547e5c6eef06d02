"""Numbers of a run, observed while its relations are written anyway."""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lakeqa.operators import costs
from lakeqa.scale import cut_lineage


class RunMeter:
    """Counters of one run: each is summed in the tasks of a write that the run needs, by no job of its own.

    ``exchange`` wraps an exchange so that tokens, dollars and failed replies of everything asked through it
    count; ``written`` writes a relation and adds up what is observed of it.
    """

    def __init__(self, mode: str = "default", ignore_token_caching: bool = True):
        self.mode, self.ignore_token_caching = mode, ignore_token_caching
        self.totals: dict[str, float] = {}

    def written(self, rows: DataFrame, **sums: Column) -> DataFrame:
        """``rows``, written and read back; ``sums`` are added to the totals of the same names."""
        seen = Observation()
        kept = cut_lineage(rows.observe(seen, *[c.alias(n) for n, c in sums.items()]))
        # An empty plan may be optimized away, and its observation with it.
        found = {} if kept.isEmpty() else seen.get
        for name in sums:
            self.totals[name] = self.totals.get(name, 0) + (found.get(name) or 0)
        return kept

    def exchange(self, exchange):
        """An exchange whose resolved requests are written, without their prompts, and counted."""

        def metered(requests: DataFrame) -> DataFrame:
            usage, failed = F.col("response.usage"), F.col("response.model").isNull()
            return self.written(
                exchange(requests).drop("request"),
                requests=F.count(F.lit(1)),
                failed_replies_ctr=F.count_if(failed),
                prompt_tokens=F.sum(usage["prompt_tokens"]),
                completion_tokens=F.sum(usage["completion_tokens"]),
                cost=F.sum(costs.dollars(F.col("response"), self.mode, self.ignore_token_caching)),
            )

        return metered
