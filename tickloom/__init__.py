"""Continuous analytics over keyed event streams, as Spark DataFrame plans."""
