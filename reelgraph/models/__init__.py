"""Model calls as Spark functions.  The models are injected; offline stand-ins are deterministic."""
