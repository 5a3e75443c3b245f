"""The usage rollup on a job log that keeps growing."""
