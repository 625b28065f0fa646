"""Plan documents: resources, references, verdicts and declarative checks."""
