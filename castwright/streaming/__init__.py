"""Profiles kept up to date as new files arrive."""
