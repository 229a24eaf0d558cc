"""Named settings with their defaults and checks, and what each means on Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "OFF")


def _positive(name: str, value: object) -> int:
    number = int(value)
    if number < 1:
        raise ValueError(f"{name} must be at least 1")
    return number


@dataclass
class Settings:
    """logging_level sets Spark's log level; the scheduler's settings have no meaning here beyond being checked and kept;
    scan_groups_in_flight is the number of row groups of 128 MB that one read task covers at most; remote_server and
    remote_port are kept for file systems that ask for them."""

    values: dict[str, object] = field(default_factory=lambda: {"logging_level": "ERROR", "scheduler_num_streams": 0, "scheduler_queue_depth": 0, "scan_groups_in_flight": 16, "remote_server": None, "remote_port": None})

    def set(self, spark: SparkSession, name: str, value: object) -> None:
        if name not in self.values:
            raise KeyError(f"no setting {name!r}; there are {', '.join(self.values)}")
        if name == "logging_level":
            value = str(value).upper()
            if value not in LEVELS:
                raise ValueError(f"logging_level must be one of {', '.join(LEVELS)}")
            spark.sparkContext.setLogLevel(value)
        elif name in ("scheduler_num_streams", "scheduler_queue_depth"):
            value = _positive(name, value)
        elif name == "scan_groups_in_flight":
            value = max(2, _positive(name, value))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(value * 8 << 20))
        elif name == "remote_port" and value is not None:
            value = int(value)
            if not 0 < value < 65536:
                raise ValueError("remote_port must be from 1 to 65535")
        self.values[name] = value

    def get(self, name: str) -> object:
        return self.values[name]


#: Options that change answers, by operator argument.
ANSWER_OPTIONS = {"sample": "rows of the strided sample", "rule": "window rule: iqr or p1p99", "bins": "number of bins", "window": "a given BinWindow instead of a derived one"}
