"""Part of pointwright; see the README."""
