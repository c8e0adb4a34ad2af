"""Column builders: normalisation, health, suggestions and fingerprints, all inside Catalyst."""
