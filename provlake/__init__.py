"""provlake: provenance labels, policy decisions and run state over logs of agent activity, on Spark."""

__version__ = "0.1.0"
