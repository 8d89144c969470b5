"""Where norms come from: catalog, landing folder, remote service, consolidated XML."""
