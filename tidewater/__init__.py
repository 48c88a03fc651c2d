"""tidewater: lending analytics, message triage and corpus preparation as Spark DataFrame transforms."""
