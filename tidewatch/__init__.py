"""Situational-awareness analytics as Spark DataFrame jobs.

``functions`` holds Column builders, ``operators`` DataFrame-to-DataFrame
operators, ``sources`` the landing and normalisation side, ``streaming`` the
Structured Streaming forms, ``plans`` the catalogue of registered queries.
"""
