"""Behaviour-log and ad-click analytics as Spark DataFrame operators."""
